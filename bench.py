"""Time the headline queries: one warm-up, then the median of three runs. Prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local threads; query names on the command line pick some.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from logmix.plans import clustering as cl
from logmix.storage import drop_staged, new_folder, stage
from workload.queries import QUERIES
from workload.tables import lineitem_index

RUNS = 3


def fit(clusters: int, collapse: bool = True, model_bytes: int = cl.mx.MODEL_BYTES, **options):
    """Three iterations on stored, encoded lineitem rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        encoded, columns = encoded_lineitem(spark, sf_dir)
        return cl.fit(
            encoded, columns, clusters, 3, seed=1, collapse=collapse, model_bytes=model_bytes, **options
        ).theta

    return run


_ENCODED: dict[str, tuple[DataFrame, list[str]]] = {}


def encoded_lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    if sf_dir not in _ENCODED:
        index = lineitem_index(spark, sf_dir)
        _ENCODED[sf_dir] = stage(index.encoded, "encoded"), index.columns
    return _ENCODED[sf_dir]


def encode_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_index(spark, sf_dir).encoded


# The given tables are single files of one row group, so a scan of one is one task; a cluster's tables are many files.
_SPREAD: dict[str, str] = {}


def many_files(name: str):
    """A query on a copy of ``documents`` in many files, which is written in the warm-up run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if sf_dir not in _SPREAD:
            _SPREAD[sf_dir] = new_folder(spark, "many-files")
            rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
            rows.repartition(32, "doc_id").write.parquet(f"{_SPREAD[sf_dir]}/documents.parquet")
        return QUERIES[name](spark, _SPREAD[sf_dir])

    return run


BENCH = {
    **{
        name: QUERIES[name]
        for name in (
            "feature_value_counts",
            "value_dictionary",
            "value_dictionary_uncapped",
            "encode_large_dictionary",
            "normalize_text",
            "extract_text_fields",
            "word_count",
            "line_index",
            "nb_score",
            "nb_assign_sampled",
            "logreg_train",
        )
    },
    "encode_lineitem": encode_lineitem,
    "fit_soft_k4": fit(4),
    "fit_soft_k32": fit(32),
    "fit_soft_k100": fit(100),
    "fit_soft_k100_no_collapse": fit(100, collapse=False),
    "fit_soft_k100_no_collapse_spread": fit(100, collapse=False, tasks=int(os.environ.get("BENCH_CPUS", "8"))),
    "fit_hard_k32": fit(32, mode="hard"),
    "fit_soft_k32_joined": fit(32, model_bytes=0),
    "normalize_text_many_files": many_files("normalize_text"),
    "word_count_many_files": many_files("word_count"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logmix-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or BENCH:
        taken = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            BENCH[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(x, 2) for x in taken], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds, median of three warm runs per query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
