"""The state of a fit: statistics, theta and prior of each iteration, appended when they exist."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.operators import mixture as mx
from logmix.storage import exists

_KINDS = ("statistics", "theta", "prior")


class FitState:
    """A folder with one table per kind, each with a partition ``iter=<i>`` per iteration.

    The prior is written last, so an iteration is whole if its prior is. What a stopped run left of a later one is replaced.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, kind: str, i: int) -> str:
        return f"{self.folder}/{kind}/iter={i}"

    def begin(self, domain: DataFrame, **options) -> None:
        """Note what is fitted, or check that it is what the folder was begun with."""
        facts = domain.agg(F.count("*"), F.sum(F.xxhash64("feature_id", "value_id", "cnt").cast("decimal(38,0)"))).first()
        noted = json.dumps({**options, "values": facts[0], "checksum": str(facts[1])}, sort_keys=True)
        path = f"{self.folder}/options"
        if exists(self.spark, f"{path}/_SUCCESS"):
            if self.spark.read.text(path).first()[0] != noted:
                raise ValueError(f"{self.folder} holds the state of a fit of other data or with other options")
        else:
            one = self.spark.createDataFrame([(noted,)], "value string").coalesce(1)
            one.write.mode("overwrite").text(path)

    def last(self) -> int:
        """The last whole iteration; 0 if there is none."""
        i = 0
        while exists(self.spark, f"{self._path('prior', i + 1)}/_SUCCESS"):
            i += 1
        return i

    def write_statistics(self, i: int, statistics: DataFrame) -> DataFrame:
        return self._write("statistics", i, statistics)

    def finish(self, i: int, theta: DataFrame, prior: Sequence[float]) -> DataFrame:
        """Write what ends an iteration, and return the written theta."""
        written = self._write("theta", i, theta)
        self._write("prior", i, mx.prior_table(self.spark, prior).coalesce(1))
        return written

    def _write(self, kind: str, i: int, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(self._path(kind, i))
        return self.spark.read.schema(table.schema).parquet(self._path(kind, i))

    def read(self, i: int) -> tuple[DataFrame, DataFrame, list[float]]:
        """``(statistics, theta, prior)`` of an iteration."""
        statistics, theta, prior = (self.spark.read.parquet(self._path(kind, i)) for kind in _KINDS)
        return statistics, theta, [r["p"] for r in prior.orderBy("k").collect()]  # one row per cluster

    def table(self) -> DataFrame:
        """``(iter, feature_id, value_id, k, n, p)`` of all iterations; the prior stands as feature -1, without statistics."""
        statistics, theta, prior = (self.spark.read.parquet(f"{self.folder}/{kind}") for kind in _KINDS)
        cells = theta.join(statistics, ["iter", "feature_id", "value_id", "k"])
        weights = prior.select(
            "iter", F.lit(-1).alias("feature_id"), F.lit(0).alias("value_id"), "k", F.lit(None).cast("double").alias("n"), "p"
        )
        return cells.select("iter", "feature_id", "value_id", "k", "n", "p").unionByName(weights)
