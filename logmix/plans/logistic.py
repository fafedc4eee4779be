"""Logistic regression by full-batch gradient descent on labels of -1 and +1."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmix.functions.vectors import dot


def components(points: DataFrame, x: str, dimensions: int) -> list[Column]:
    """The components of an array column as separate expressions."""
    return [F.get(points[x], F.lit(i)) for i in range(dimensions)]


def gradient(points: DataFrame, y: Column, x: Sequence[Column], weights: Sequence[float]) -> DataFrame:
    """One row ``g0 …``: the summed gradient of the logistic loss, in one pass with partial sums per task."""
    slope = (F.lit(1.0) / (F.lit(1.0) + F.exp(-y * dot(weights, x))) - F.lit(1.0)) * y
    terms = points.select(slope.alias("slope"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    return terms.agg(*[F.sum(F.col("slope") * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(x))])


def start_weights(dimensions: int, seed: int = 42) -> list[float]:
    draw = random.Random(seed)
    return [2 * draw.random() - 1 for _ in range(dimensions)]


def train_logistic(
    points: DataFrame,
    y: Column,
    x: Sequence[Column],
    iterations: int,
    *,
    weights: Sequence[float] | None = None,
    step: float = 1.0,
    seed: int = 42,
) -> list[float]:
    """Weights after a fixed number of steps against the gradient.

    The columns in use are kept for the next pass, on disk where memory ends. Only the gradient reaches the driver.
    """
    names = [f"x{i}" for i in range(len(x))]
    used = points.select(y.alias("y"), *[c.alias(n) for c, n in zip(x, names)]).persist(StorageLevel.MEMORY_AND_DISK)
    w = list(weights) if weights is not None else start_weights(len(x), seed)
    for _ in range(iterations):
        g = gradient(used, F.col("y"), [F.col(n) for n in names], w).first()
        w = [wi - step * (gi or 0.0) for wi, gi in zip(w, g)]
    used.unpersist()
    return w
