"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of a hash, are cut into blocks of ``block`` rows. Weights are rounded to whole slots of a
period of 2^40. Block j of a source with n of P slots is released at ``floor(j P / n)`` and due at ``ceil((j + 1) P / n)``;
each slot goes to the released block that is due first (ties: the name). Every block then runs within its window, and after t
slots a source has had t n / P blocks, less than one more or less. For k sources n / P differs from the weight by at most
(k + 1) / P, so t slots are off the weight by t (k + 1) / P blocks besides: 0.00001 for 20 sources and 450,000 slots.

The driver lays out the slots that the table's blocks take (no more of the period), so it holds two numbers for each block.

Nothing is dropped: once a source has no blocks left its slots are skipped, and the others go on in proportion. From slot
``_SKIPPED`` on the slots of such a source are not laid out any more: they are left to the others, whose blocks still run
within their windows, so that small weights do not make the layout longer than the table. A row's ``position`` counts the
rows before it, so positions are 0, 1, 2 ... without gaps.

The rank of a row in its source is made from counts by (source, range of the hash), so a source with a third of all rows is
spread over many tasks.

Weights must be positive numbers by source; without them the weight is the square root of a source's number of rows. A
source without a weight is an error. A null source counts as the empty name. Rows with one id and text are told apart by
nothing and take neighbouring places; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, PERIOD = 16, 1 << 40
_SKIPPED = 4_000_000
_RANGE_ROWS = 4_000  # rows of a source that one task ranks, about


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period by largest remainder, at least one for each."""
    if min(weights.values(), default=1) <= 0 or len(weights) > period:
        raise ValueError("weights must be positive, and at most as many as the period has slots")
    spare = period - len(weights)
    total = sum(map(Fraction, weights.values()))
    exact = {s: spare * Fraction(w) / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


@dataclass(frozen=True)
class Schedule:
    """The slots of each source's blocks: of a whole period, which repeats, or of the blocks that there are."""

    sources: list[str]
    slots: list[int]  # per period, by source
    period: int
    place: list[np.ndarray]

    @property
    def before(self) -> np.ndarray:
        """(slots laid out, sources): how many blocks each source has had before each slot."""
        last = max((int(p[-1]) for p in self.place if len(p)), default=-1)
        return np.stack([np.searchsorted(p, np.arange(last + 1)) for p in self.place], axis=1)

    def window(self, source: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, exact = self.slots[source], block.astype(object)  # products of more than 64 bits
        return (exact * self.period // n).astype(np.int64), (-(-(exact + 1) * self.period // n)).astype(np.int64)

    def slot(self, source: int, block: np.ndarray) -> np.ndarray:
        n = len(self.place[source])
        return block // n * self.period + self.place[source][block % n]

    def starts(self, rows: Sequence[int], block: int) -> list[np.ndarray]:
        """How many rows stand before each block laid out, by source, if source k has ``rows[k]``."""
        sizes = [np.minimum(block, n - np.arange(len(p)) * block) for n, p in zip(rows, self.place, strict=True)]
        order = np.argsort(np.concatenate([*self.place, np.zeros(0, np.int64)]))
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])[order]
        ahead = np.zeros(len(order), np.int64)
        ahead[order] = np.cumsum(size) - size
        return np.split(ahead, np.cumsum([len(p) for p in self.place])[:-1])


def schedule(weights: Mapping[str, float], period: int = PERIOD, blocks: Mapping[str, int] | None = None) -> Schedule:
    """Earliest deadline first over ``blocks`` of each source, by default over those of one period."""
    by_source = shares(weights, period)
    sources = sorted(by_source)
    slots = [by_source[s] for s in sources]
    wanted = slots if blocks is None else [blocks[s] for s in sources]
    place: list[list[int]] = [[] for _ in sources]
    done = [0] * len(sources)
    waiting, ready = [(0, i) for i in range(len(sources))], []  # by release, by deadline
    left, t = sum(wanted), 0
    while left:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * period // slots[i]), i))
        if not ready:
            t = waiting[0][0]
            continue
        i = heapq.heappop(ready)[1]
        if done[i] < wanted[i]:
            place[i].append(t)
            left -= 1
        elif t >= _SKIPPED:
            continue
        done[i] += 1
        heapq.heappush(waiting, (done[i] * period // slots[i], i))
        t += 1
    return Schedule(sources, slots, period, [np.array(p, np.int64) for p in place])


def mix(
    docs: DataFrame,
    keep: Sequence[str],
    source: str = "source",
    key: str = "doc_id",
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK,
    period: int = PERIOD,
) -> DataFrame:
    """The columns ``keep`` and ``block, release, deadline, slot, position`` of every row."""
    rows = docs.select(
        *keep, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(key).alias("_key"), F.xxhash64(F.lit(3), key).alias("_hash")
    )
    sizes = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    weights = {s: n**0.5 for s, n in sizes.items()} if weights is None else weights
    if missing := sizes.keys() - weights.keys():
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    plan = schedule({s: weights[s] for s in sizes}, period, {s: -(-n // block) for s, n in sizes.items()})
    starts = plan.starts([sizes[s] for s in plan.sources], block)
    # Ranges of the hash, as many as the largest source needs.
    ranges = max(1, -(-max(sizes.values(), default=1) // _RANGE_ROWS))
    spot = F.floor((F.shiftrightunsigned("_hash", 32) * ranges) / F.lit(2.0**32))
    rows = rows.withColumn("_range", spot.cast("long"))
    per_range = rows.groupBy("_source", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("_source", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_range").orderBy("_hash", "_key")
    ranked = rows.withColumn("_nth", F.row_number().over(inside)).join(offsets, ["_source", "_range"])
    ranked = ranked.select(*keep, "_source", (F.col("_offset") + F.col("_nth") - 1).alias("_rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    names = [*keep, "block", "release", "deadline", "slot", "position"]

    def place(batches):
        index = {s: i for i, s in enumerate(plan.sources)}
        for batch in batches:
            of = np.array([index[s] for s in batch.column("_source").to_pylist()], np.int64)
            rank = batch.column("_rank").to_numpy()
            nth = rank // block
            release, deadline, slot, ahead = (np.zeros(len(rank), np.int64) for _ in range(4))
            for i in np.unique(of).tolist():
                own = np.flatnonzero(of == i)
                release[own], deadline[own] = plan.window(i, nth[own])
                slot[own], ahead[own] = plan.slot(i, nth[own]), starts[i][nth[own]]
            made = [nth, release, deadline, slot, ahead + rank % block]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, made)], names)

    return ranked.mapInArrow(place, f"{schema}, block long, release long, deadline long, slot long, position long")


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of ``position``, over as many range partitions as the shuffle has."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "position").sortWithinPartitions("position")
