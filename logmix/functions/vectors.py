"""Column functions on vectors held as arrays or as one column per component."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_vectors(a: Column, b: Column) -> Column:
    """Element-wise sum; vectors of different lengths are an error."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, lambda x, y: x + y)).otherwise(
        F.raise_error(F.lit("vectors differ in length"))
    )


def dot(weights: Sequence[float], components: Sequence[Column]) -> Column:
    """Dot product of fixed weights with columns."""
    if len(weights) != len(components):
        raise ValueError("vectors differ in length")
    return reduce(lambda s, wx: s + wx, [F.lit(float(w)) * x for w, x in zip(weights, components)])


def vector_line(components: Sequence[Column]) -> Column:
    """Integers joined by one space; a missing one prints as -1."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("-1")) for c in components])
