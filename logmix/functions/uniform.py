"""Repeatable random numbers that depend only on a seed and a key, never on partitioning or task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 12


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the key columns."""
    text = F.concat_ws(",", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    digits = F.substring(F.md5(text.cast("binary")), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))
