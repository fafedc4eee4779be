"""Counting operators over the cells of a wide table: one cell per row and feature, missing cells left out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_cells(df: DataFrame, columns: Sequence[str], feature_ids: Sequence[int], *keep: str) -> DataFrame:
    """Unpivot ``columns`` to ``(keep…, feature_id, value)``, without missing cells."""
    pairs = [part for c, i in zip(columns, feature_ids) for part in (F.lit(i), F.col(c))]
    long = df.select(*keep, F.stack(F.lit(len(columns)), *pairs).alias("feature_id", "value"))
    present = F.col("value").isNotNull()
    if dict(df.dtypes)[columns[0]] == "string":
        present = present & (F.col("value") != "")
    return long.where(present)


def value_counts(df: DataFrame, columns: Sequence[str], feature_ids: Sequence[int]) -> DataFrame:
    """``(feature_id, value, cnt)``. Partial aggregation shrinks hot values before the shuffle."""
    return to_cells(df, columns, feature_ids).groupBy("feature_id", "value").agg(F.count("*").alias("cnt"))


def encoded_value_counts(
    df: DataFrame, columns: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(feature_id, value_id, cnt, patterns)`` of integer-coded columns; negative ids are missing.

    ``cnt`` adds up ``weight`` and ``patterns`` counts table rows.
    """
    keep = [weight] if weight else []
    total = F.sum(weight) if weight else F.count("*")
    return (
        to_cells(df, columns, range(len(columns)), *keep)
        .where("value >= 0")
        .groupBy("feature_id", F.col("value").alias("value_id"))
        .agg(total.alias("cnt"), F.count("*").alias("patterns"))
    )


def cardinality(counts: DataFrame) -> DataFrame:
    """``(feature_id, v_size)``: exact number of distinct values, from a table with one row per value."""
    return counts.groupBy("feature_id").agg(F.count("*").alias("v_size"))


def value_sketches(df: DataFrame, columns: Sequence[str], rsd: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature_id, sketch)``: a sketch of the distinct values of each column, for each group ``by``.

    One pass without an unpivot; a sketch of a bounded size per group and column travels from each task. Sketches of the same
    ``rsd`` can be stored and united later (``united_sketches``). A column without values has an empty sketch.
    """
    bits = max(4, math.ceil(2 * math.log2(1.04 / rsd)))
    if bits > 21:
        raise ValueError("rsd must be at least 0.00072")
    wide = df.groupBy(*by).agg(*[F.hll_sketch_agg(c, bits).alias(f"_sketch{i}") for i, c in enumerate(columns)])
    return wide.select(
        *by, F.posexplode(F.array(*[f"_sketch{i}" for i in range(len(columns))])).alias("feature_id", "sketch")
    )


def united_sketches(sketches: DataFrame) -> DataFrame:
    """``(feature_id, sketch)`` over all groups; an error if they were made with different ``rsd``."""
    return sketches.groupBy("feature_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """``(feature_id, v_approx)`` from one sketch per feature.

    A sketch that was never united is estimated by another formula than a united one. Each is united with itself first, so the
    estimate depends on the values alone, not on how many tasks or parts they came from.
    """
    return sketches.select("feature_id", F.hll_sketch_estimate(F.hll_union("sketch", "sketch")).alias("v_approx"))


def approx_cardinality(df: DataFrame, columns: Sequence[str], rsd: float = 0.01) -> DataFrame:
    """``(feature_id, v_approx)`` with relative standard deviation ``rsd``, in one pass."""
    return sketched_cardinality(value_sketches(df, columns, rsd))


def largest_domain(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.max("v_size").alias("max_v_size"))


def within_cutoff(
    sizes: DataFrame, min_cutoff: int = 1, max_cutoff: int | None = None, min_exclusive: bool = False
) -> DataFrame:
    """Features with ``min <= v_size <= max``, or ``min < v_size <= max`` if ``min_exclusive``."""
    size = F.col("v_size")
    keep = size > min_cutoff if min_exclusive else size >= min_cutoff
    if max_cutoff is not None:
        keep = keep & (size <= max_cutoff)
    return sizes.where(keep)


def empty_features(spec: DataFrame, sizes: DataFrame) -> DataFrame:
    """Raw (flag 0) rows of ``spec`` for which no value was counted."""
    return spec.where("flag = 0").join(sizes, spec["pos"] == sizes["feature_id"], "left_anti")


def out_of_domain_cells(cells: DataFrame, domain: DataFrame) -> DataFrame:
    """Cells whose (feature, value id) is not in ``domain``, counted per feature and id.

    The cells are counted before the join, so a hot value crosses the shuffle as one row per task.
    """
    counted = cells.groupBy("feature_id", "value_id").agg(F.count("*").alias("cells"))
    return counted.join(domain, ["feature_id", "value_id"], "left_anti")
