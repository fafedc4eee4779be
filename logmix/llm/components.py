"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.storage import drop_table, stage

_MOST_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """One large and one small star: every node moves to the least node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # Now b < a everywhere.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (long columns a, b); a component is its least node.

    Each round is written to the shared folder. Loops and repeated edges do no harm; without edges there are no rows.
    """
    state, last = stage(edges.where("a <> b").select("a", "b"), "edges"), None
    for _ in range(_MOST_ROUNDS):
        found = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == last:
            break
        moved = stage(_star(state), "edges")
        drop_table(state)
        state, last = moved, found
    else:
        raise RuntimeError("the components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
