"""Looking up one column of a large table in a keyed table of any size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Together, the tables broadcast by one plan stay below this size.
BROADCAST_BYTES = 256 * 1024 * 1024
# Rows are shuffled by their key and one of this many slots; a row without a partner to seek takes any slot.
_SLOTS = 65536


@dataclass(frozen=True)
class Keyed:
    """A lookup table ``(key, payload, cnt)``: of ``rows`` filled cells in the large table, ``cnt`` hold ``key``."""

    table: DataFrame
    key: str
    payload: str
    rows: int


def split_budget(sizes: dict[int, int], budget: int = BROADCAST_BYTES) -> set[int]:
    """The tables to broadcast: smallest first, as long as their total stays within the budget."""
    chosen, used = set(), 0
    for name, size in sorted(sizes.items(), key=lambda item: (item[1], item[0])):
        used += size
        if used > budget:
            break
        chosen.add(name)
    return chosen


def lookup(df: DataFrame, column: str, keyed: Keyed, out: str, small: bool, row_id: Column | None = None) -> DataFrame:
    """Add ``out``, the payload for ``df[column]``, NULL where the cell is missing or unknown.

    A small table is broadcast. Otherwise the hot keys (few by definition) are broadcast and the rest is joined through
    a shuffle; rows that already found their partner or have none are spread over all slots, so no shuffle partition
    receives a hot key. ``row_id`` must be a stored or scan-stable number, so that retried tasks agree.
    """
    found = keyed.table.select(F.col(keyed.key).alias("_key"), F.col(keyed.payload).alias("_found"), "cnt")
    if small:
        return (
            df.join(F.broadcast(found.drop("cnt")), F.col(column) == F.col("_key"), "left")
            .withColumnRenamed("_found", out)
            .drop("_key")
        )
    # A key is hot if it fills the mean shuffle partition; there can be no more such keys than partitions.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("cnt") * partitions >= F.lit(keyed.rows)
    hot = found.where(is_hot).select("_key", F.col("_found").alias("_hot"))
    slot = lambda key: F.pmod(F.xxhash64(key), F.lit(_SLOTS))
    cold = found.where(~is_hot).select(
        F.col("_key").alias("_cold_key"), slot("_key").alias("_cold_slot"), F.col("_found").alias("_cold")
    )
    settled = F.col("_hot").isNotNull() | F.col(column).isNull()
    joined = (
        df.join(F.broadcast(hot), F.col(column) == F.col("_key"), "left")
        .withColumn("_seek", F.when(~settled, F.col(column)))
        .withColumn("_slot", F.when(settled, slot(row_id)).otherwise(slot(column)))
    )
    return (
        joined.join(
            cold,
            (F.col("_seek") == F.col("_cold_key")) & (F.col("_slot") == F.col("_cold_slot")),
            "left",
        )
        .withColumn(out, F.coalesce("_hot", "_cold"))
        .drop("_key", "_hot", "_seek", "_slot", "_cold_key", "_cold_slot", "_cold")
    )
