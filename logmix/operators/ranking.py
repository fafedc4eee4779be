"""Numbering rows in order when a group may be larger than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmix.storage import drop_table, stage

# monotonically_increasing_id() holds the partition number above this many bits of row position.
_POSITION_BITS = 33


def rank_ordered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, stored: bool = False
) -> DataFrame:
    """0-based number of each row within its group, for groups of any size.

    A range-partitioned sort spreads even one giant group over all tasks, given that ``group`` and ``order`` together
    tell rows apart. The number of groups must be small (features, or none). Each sorted slice knows its own positions; what it lacks is how many rows of the group lie in
    earlier slices, and that is a running sum over one number per slice and group.

    Finding the ranges reads the rows once more than sorting them. Unless ``stored`` says that they come from a stored table,
    they are stored first, so that the plan behind them runs once.
    """
    rows = df if stored else stage(df, "unordered")
    ordered = stage(
        rows.orderBy(*group, *order).withColumn("_pos", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_slice", F.shiftright("_pos", _POSITION_BITS))
    if not stored:
        drop_table(rows)

    # One row per slice and group: small enough to order in one task when there is a single group.
    runs = ordered.groupBy(*group, "_slice").agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *group, "_slice", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    number = F.col("_start") + F.col("_pos") - F.col("_first")
    # Sorted slices cut the groups into at most (slices + groups - 1) runs, so this side stays small if the groups
    # are features.
    return (
        ordered.join(F.broadcast(starts), [*group, "_slice"])
        .withColumn(name, number)
        .drop("_pos", "_slice", "_first", "_start")
    )
