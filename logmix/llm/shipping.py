"""Brings this package to the executors, which need no installed copy of it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import logmix
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from logmix.storage import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package, written to the shared folder, to the application once."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(logmix.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent).as_posix())
    folder = f"{shared_folder(spark).rstrip("/")}/logmix-package-{application}"
    folder = folder if "://" in folder or folder.startswith("/") else "/" + folder.partition(":/")[2]
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/logmix.zip") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/logmix.zip")
    _shipped.add(application)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` with the package shipped first; the first argument is the session."""

    @wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ship(spark)
        return query(spark, *rest)

    return run
