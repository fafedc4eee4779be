"""Where intermediate tables live.

A staged table is written as parquet to the cluster's shared checkpoint folder and read back. That cuts the lineage,
survives the loss of any executor, keeps the columnar layout for later passes, and gives the optimizer real sizes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Below the default Hadoop file system's root, where no checkpoint folder is named.
STAGING = "/tmp/logmix-staging"


def _default_folder(spark: SparkSession) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(STAGING)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; if none is named, one on the default Hadoop file system.

    A default file system that is each machine's own is refused unless the tasks run in the driver itself.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    whole = _default_folder(spark)
    in_driver = spark.sparkContext.master.partition("[")[0] == "local"
    if whole.startswith("file:") and not in_driver:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return whole


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


_scope: ContextVar[str] = ContextVar("scope", default="")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for a new folder of this application in the shared folder; nothing is created."""
    return f"{_folder(spark)}/{_scope.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete all that is staged inside when it ends, also by an error. Nothing returned may read it."""
    name = f"scope-{uuid.uuid4().hex}"
    token = _scope.set(f"{name}/")
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, f"{_folder(spark)}/{name}")


def stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in one directory per value of ``by``, and return the stored table."""
    path = new_folder(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def staged_path(df: DataFrame) -> str | None:
    """The folder of a table that ``stage`` returned; None for other tables and for one without files."""
    application = re.escape(df.sparkSession.sparkContext.applicationId)
    found = [re.match(rf"(.*/{application}/(?:scope-[0-9a-f]{{32}}/)?[^/]+-[0-9a-f]{{32}})/", f) for f in df.inputFiles()[:1]]
    return found[0][1] if found and found[0] else None


@dataclass(frozen=True)
class Bucketed:
    """A stored table in buckets by some columns; joins and groupings on just these need no shuffle of it."""

    spark: SparkSession
    name: str
    folder: str

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.folder)


def write_buckets(df: DataFrame, by: Sequence[str], label: str) -> Bucketed:
    """Write ``df`` to the shared folder, in as many buckets by ``by`` as there are shuffle partitions, one file each."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, label)
    name = f"logmix_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).option("path", folder).format("parquet").saveAsTable(name)
    return Bucketed(spark, name, folder)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``path``, then put it in the place of what is there.

    A write that fails leaves the old folder whole. Both renames follow each other at once; where a store's renames are
    copies, a reader may find no folder in between.
    """
    path = path.rstrip("/")
    name = path.rpartition("/")[2]
    parent = path[: len(path) - len(name)]
    # Names that begin with an underscore are hidden from readers of the parent folder.
    beside, old = (f"{parent}_{name}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        write(beside)
    except BaseException:
        delete(spark, beside)
        raise
    place = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    system = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.exists(place(path))
    if held and not system.rename(place(path), place(old)):
        delete(spark, beside)
        raise OSError(f"{path} could not be moved")
    if not system.rename(place(beside), place(path)):
        if held:
            system.rename(place(old), place(path))
        raise OSError(f"{beside} could not be moved to {path}")
    delete(spark, old)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete one staged table; nothing that still reads it may run later."""
    if folder := staged_path(df):
        delete(df.sparkSession, folder)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged by this application. Results that still read them must be saved first."""
    delete(spark, _folder(spark))
