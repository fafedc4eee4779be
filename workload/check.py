"""Run queries against their SQL: ``python -m workload.check [sf_dir] [query …]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    for name in TABLES.split():
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return base


def difference(spark: SparkSession, base: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """None if the query and its SQL return the same rows, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    result = base.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0]!r:.600}" if wrong else None


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            found = difference(spark, base, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            found = f"failed: {str(error)[:1500]}"
        print(f"{'ok  ' if found is None else 'BAD '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main()
