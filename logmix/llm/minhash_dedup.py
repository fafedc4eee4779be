"""Near-duplicate components: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets are one class, so copies are never paired.
2. Classes that share a band of their signature are candidates. A task keeps one class per band key and sends only that,
   so a band shared by a third of all rows stays small; the edges (class, least class of the band) grow linearly. Their
   connected components hold all candidate pairs.
3. Each class is compared with its component's pivot, its least class. Signatures are compared batch by batch; after n
   positions with m equal, the similarity has the posterior Beta(1 + m, 1 + n - m), and a pair leaves when the chance of
   reaching the threshold falls below ``miss``. Survivors are verified on the full sets. The pivots' sets are sorted
   arrays in the shared folder, mapped by the tasks, so nothing else moves.
4. Classes that are not linked with their pivot are compared, in blocks, with all classes of their component, again by
   batches and exact sets, but for those already connected. No cap: what is large becomes more blocks.
5. Components of the verified links, carried back to the rows of each class.

A pair at the threshold is no candidate with a chance of ``(1 - t^rows)^bands``, at most ``miss``: bands are as long as that
allows, 24 of 5 at a threshold of 0.85 (8e-7), 30 of 4 at 0.8 (1.4e-7). A text with fewer words than a
shingle is one shingle; a text without words (or null) links with nothing and is its own component. Repeated rows share
their class. A row without an id counts as larger than all others. Other columns are ignored; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm.components import components
from logmix.llm.store import Store, build, map_file, write_arrays
from logmix.storage import new_folder, stage

_NO_ID = np.iinfo(np.int64).max
_BLOCK = 2000  # classes of one side of a block
_FLUSH = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Link sets with ``100 * common >= percent * union``. The signature has at least ``least`` positions, cut into bands."""

    shingle: int = 5
    percent: int = 80
    batch: int = 24
    miss: float = 1e-6
    least: int = 120

    @cached_property
    def rows(self) -> int:
        """Positions of a band."""
        return self._layout[1]

    @cached_property
    def bands(self) -> int:
        return self._layout[0] // self._layout[1]

    @property
    def positions(self) -> int:
        return self._layout[0]

    @cached_property
    def _layout(self) -> tuple[int, int]:
        """The fewest positions, whole batches, and the longest bands of them, that miss a pair at the threshold rarely enough."""
        if not 0 < self.percent <= 100 or not 0 < self.miss < 1:
            raise ValueError("percent must be above 0 and at most 100, miss between 0 and 1")
        for positions in count(-(-self.least // self.batch) * self.batch, self.batch):
            for rows in range(positions, 0, -1):
                if positions % rows == 0 and (1 - (self.percent / 100) ** rows) ** (positions // rows) <= self.miss:
                    return positions, rows

    def least_matches(self) -> list[tuple[int, int]]:
        """After the first n positions, the fewest equal ones with which a pair stays."""
        t, out = self.percent / 100, []
        for n in range(self.batch, self.positions + 1, self.batch):
            chance, m = 0.0, -1
            while chance < self.miss and m < n:
                m += 1
                chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def _coefficients(positions: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, (2, positions), dtype=np.uint32)
    return made[0] | np.uint32(1), made[1] | np.uint32(1)


def signatures(values: np.ndarray, number: np.ndarray, positions: int) -> np.ndarray:
    """For each set of hashes, end to end in ``values``, the least value under each of several hash functions."""
    out = np.zeros((len(number), positions), np.uint32)
    full = np.flatnonzero(number)
    if not len(full):
        return out
    at = (np.cumsum(number) - number)[full]
    high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    for i, (a, b) in enumerate(zip(*_coefficients(positions), strict=True)):
        out[full, i] = np.minimum.reduceat(high * a + low * b, at)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in order, end to end, and their number."""
    hashes, counts = bt.words(data, offsets)
    found, number = bt.shingles(hashes, counts, shingle)
    text = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[keep], np.bincount(text[keep], minlength=len(number))


def _classes(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of each set, the same in any order."""
    out = np.zeros(len(number), np.uint64)
    full = np.flatnonzero(number)
    if len(full):
        out[full] = np.add.reduceat(bt.mix(values ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(number) - number)[full])
    return bt.mix(out + number.astype(np.uint64)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = bt.raw_texts(batch.column("_text"))
        ids = batch.column("_id").to_numpy(zero_copy_only=False)
        for a, b in bt.slices(offsets):
            part = offsets[a : b + 1]
            yield ids[a:b], data[part[0] : part[-1]], part - part[0]


def _chosen(batches, wanted: Store, groups: Store, settings: Settings):
    """Sets and signatures of the classes that are looked for, found by the ids of their first rows."""
    for ids, data, offsets in _slices(batches):
        keys = bt.mix(ids.view(np.uint64))
        distinct, back = np.unique(keys, return_inverse=True)
        take = np.flatnonzero((wanted.lookup(distinct, [0])[0] > 0)[back])
        if not len(take):
            continue
        parts = [data[offsets[i] : offsets[i + 1]] for i in take]
        own = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        values, number = _sets(np.concatenate(parts), own, settings.shingle)
        nodes = _classes(values, number)
        distinct, back = np.unique(bt.mix(nodes.view(np.uint64)), return_inverse=True)
        group, known = (x[back] for x in groups.lookup(distinct, [0, 0]))
        signs = signatures(values, number, settings.positions)
        ends = np.cumsum(number)
        for i in np.flatnonzero(known):
            yield int(nodes[i]), int(group[i]), signs[i], values[ends[i] - number[i] : ends[i]]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: are two sorted sets alike enough?"""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _survivors(one: np.ndarray, many: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Places in ``many`` whose signatures stay in the race against ``one``, batch after batch."""
    stay, matches, done = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for n, m in least:
        matches += (many[stay, done:n] == one[done:n]).sum(axis=1)
        keep = matches >= m
        stay, matches, done = stay[keep], matches[keep], n
        if not len(stay):
            break
    return stay


class _Pivots:
    """Signatures and sets by group: ``(key, start, end)`` in a store, the numbers in a file beside it."""

    def __init__(self, index: Store, data: dict[int, str], positions: int):
        self.index, self.data, self.positions, self.mapped = index, data, positions, {}

    def __getstate__(self):
        return {**self.__dict__, "mapped": {}}

    def get(self, group: int) -> tuple[np.ndarray, np.ndarray] | None:
        key = bt.mix(np.array([group], np.int64).view(np.uint64))
        shard = int(bt.shard_of(key, self.index.shards)[0])
        start, end = (int(x[0]) for x in self.index.lookup(key, [0, 0]))
        if end == start:
            return None
        if shard not in self.mapped:
            self.mapped[shard] = map_file(self.index.folder, self.data[shard]).view("<u8")
        found = self.mapped[shard][start:end]
        half = self.positions // 2
        return found[:half].view(np.uint32), found[half:]


def _store_pivots(rows: DataFrame, settings: Settings, shards: int) -> _Pivots:
    folder = new_folder(rows.sparkSession, "pivots")

    def write(part: pa.Table) -> pa.Table:
        keys = part.column("node").to_numpy().view(np.uint64)
        keys, first = np.unique(bt.mix(keys), return_index=True)
        numbers = [np.frombuffer(part.column(c)[i].as_py(), "<u8") for i in first.tolist() for c in ("signature", "members")]
        sizes = np.array([len(x) for x in numbers]).reshape(-1, 2).sum(axis=1)
        ends = np.cumsum(sizes)
        index = write_arrays(folder, [keys, ends - sizes, ends])
        return pa.table({"shard": [part.column("shard")[0].as_py()], "index": [index], "data": [write_arrays(folder, numbers)]})

    files = rows.groupBy("shard").applyInArrow(write, "shard long, index string, data string").collect()  # one per shard
    index = Store(folder, {r["shard"]: r["index"] for r in files}, shards, ["<u8", "<i8", "<i8"])
    return _Pivots(index, {r["shard"]: r["data"] for r in files}, settings.positions)


def _block_links(part: pa.Table, settings: Settings) -> pa.Table:
    """Links of a block of unlinked classes with a block of their component, enough of them to connect what is linked."""
    part = part.sort_by([("node", "ascending")])
    nodes, left, root = (part.column(c).to_numpy() for c in ("node", "is_left", "root"))
    signs = np.stack([np.frombuffer(x, np.uint32) for x in part.column("signature").to_pylist()])
    sets = [np.frombuffer(x, np.uint64) for x in part.column("members").to_pylist()]
    # A class may stand on both sides; linked ones begin together.
    group = np.unique(root, return_inverse=True)[1]
    least, out = settings.least_matches(), []
    right = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        for j in right[_survivors(signs[i], signs[right], least)]:
            if group[i] != group[j] and nodes[i] != nodes[j] and _linked(sets[i], sets[j], settings.percent):
                out.append((nodes[i], nodes[j]))
                group[group == group[i]] = group[j]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def near_duplicates(docs: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """One row ``(key, n_shingles, component_id, kept)`` per row of ``docs``; a component is named by its least key."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text).alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("_id"))

    def sign(batches):
        for ids, data, offsets in _slices(batches):
            values, number = _sets(data, offsets, settings.shingle)
            signs = signatures(values, number, settings.positions)
            yield pa.record_batch(
                [pa.array(ids), pa.array(number), pa.array(_classes(values, number)), pa.array([s.tobytes() for s in signs], pa.binary())],
                ["id", "n_shingles", "node", "signature"],
            )

    signed = stage(texts.mapInArrow(sign, "id long, n_shingles long, node long, signature binary"), "signatures")
    classes = stage(
        signed.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("first")), "classes"
    )

    def band_keys(nodes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = signs.reshape(len(signs), settings.bands, settings.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), cut.shape[:2])
        for r in range(settings.rows):
            keys = bt.mix(keys * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
        return keys.ravel(), np.repeat(nodes, settings.bands)

    def stars(keys: np.ndarray, nodes: np.ndarray):
        """The least class of each key, and an edge to it from every other."""
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        lead = np.concatenate([[True], keys[1:] != keys[:-1]])
        least = nodes[lead][np.cumsum(lead) - 1]
        other = nodes != least
        edges = np.unique(np.stack([nodes[other], least[other]]), axis=1)
        return keys[lead], nodes[lead], edges

    names = ["shard", "blob", "a", "b"]
    schema = "shard long, blob binary, a long, b long"

    def edge_batch(edges: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(edges.shape[1], pa.int64()), pa.nulls(edges.shape[1], pa.binary())
        return pa.record_batch([*none, pa.array(edges[0]), pa.array(edges[1])], names)

    def send_bands(batches):
        held, size = [], 0
        for batch in batches:
            raw = b"".join(batch.column("signature").to_pylist())
            signs = np.frombuffer(raw, np.uint32).reshape(-1, settings.positions)
            held.append(band_keys(batch.column("node").to_numpy(), signs))
            size += len(held[-1][0])
            if size > _FLUSH:
                yield from send_held(held)
                held, size = [], 0
        if size:
            yield from send_held(held)

    def send_held(held):
        keys, nodes, edges = stars(*(np.concatenate(x) for x in zip(*held)))
        yield edge_batch(edges)
        bounds = bt.shard_bounds(keys, shards)
        used = np.flatnonzero(np.diff(bounds))
        blobs = [bt.pack(keys[bounds[k] : bounds[k + 1]], nodes[bounds[k] : bounds[k + 1]].view("u8")) for k in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(blobs, pa.binary()), none, none], names)

    def join_bands(part: pa.Table) -> pa.Table:
        blobs = [bt.unpack(b, 2) for b in part.column("blob").to_pylist()]
        _, _, edges = stars(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).view(np.int64))
        return pa.table({"a": edges[0], "b": edges[1]})

    def candidates() -> DataFrame:
        """Edges within tasks and, once, between them."""
        sent = stage(signed.where("n_shingles > 0").select("node", "signature").mapInArrow(send_bands, schema), "bands")
        between = sent.where("shard is not null").select("shard", "blob").repartition(shards, "shard")
        joined = between.groupBy("shard").applyInArrow(join_bands, "a long, b long")
        return joined.unionByName(sent.where("a is not null").select("a", "b")).distinct()

    loose = stage(components(candidates()), "loose")
    members = loose.join(classes, "node").withColumn("one", F.lit(1).cast("long"))
    members = stage(members, "members")
    groups = build(members, "node", ["component", "one"], "groups")
    firsts = build(members, "first", ["one"], "firsts")
    pivots = build(members.where("node = component"), "first", ["one"], "pivot-ids")

    def pivot_sets(batches):
        for node, group, signature, values in _chosen(batches, pivots, groups, settings):
            if node == group:
                shard = int(bt.shard_of(bt.mix(np.array([node], np.int64).view(np.uint64)), shards)[0])
                yield pa.record_batch(
                    [pa.array([shard]), pa.array([node]), pa.array([signature.tobytes()]), pa.array([values.tobytes()])],
                    ["shard", "node", "signature", "members"],
                )

    sent = texts.mapInArrow(pivot_sets, "shard long, node long, signature binary, members binary")
    stored = _store_pivots(sent.repartition(shards, "shard"), settings, shards)
    least = settings.least_matches()

    def verify(batches):
        seen = set()
        for node, group, signature, values in _chosen(batches, firsts, groups, settings):
            if node == group or node in seen:
                continue
            seen.add(node)
            sign, own = stored.get(group)
            linked = len(_survivors(signature, sign[None], least)) > 0 and _linked(values, own, settings.percent)
            yield pa.record_batch([pa.array([node]), pa.array([group]), pa.array([linked])], ["node", "component", "linked"])

    tested = stage(texts.mapInArrow(verify, "node long, component long, linked boolean").distinct(), "tested")
    # What is left: components of three or more classes in which some are not linked with the pivot.
    sizes = tested.groupBy("component").agg(
        F.count("*").alias("others"), F.count_if(~F.col("linked")).alias("unlinked")
    ).where("unlinked > 0 and others > 1")
    # The pivot has been compared with all; it stands for its component only through those linked with it.
    left = stage(tested.join(sizes, "component"), "unlinked")
    plan = build(
        left.withColumn("linked", F.col("linked").cast("long")).join(classes, "node"),
        "node", ["component", "linked", "others", "unlinked"], "left",
    )
    left_firsts = build(left.join(classes, "node").withColumn("one", F.lit(1).cast("long")), "first", ["one"], "left-ids")

    def send_blocks(batches):
        seen = set()
        for node, group, signature, values in _chosen(batches, left_firsts, groups, settings):
            key = bt.mix(np.array([node], np.int64).view(np.uint64))
            component, linked, others, unlinked = (int(x[0]) for x in plan.lookup(key, [0, 0, 0, 0]))
            if not others or node in seen:
                continue
            seen.add(node)
            wide, high = -(-others // _BLOCK), -(-unlinked // _BLOCK)
            mine = int(key[0] >> np.uint64(8))
            places = [(i, mine % wide, False) for i in range(high)]
            places += [] if linked else [(mine // 7 % high, j, True) for j in range(wide)]
            root = component if linked else node
            n = len(places)
            yield pa.record_batch(
                [
                    pa.array([component] * n), pa.array([p[0] for p in places]), pa.array([p[1] for p in places]),
                    pa.array([p[2] for p in places]), pa.array([node] * n), pa.array([root] * n),
                    pa.array([signature.tobytes()] * n), pa.array([values.tobytes()] * n),
                ],
                ["component", "i", "j", "is_left", "node", "root", "signature", "members"],
            )

    blocks = texts.mapInArrow(
        send_blocks, "component long, i long, j long, is_left boolean, node long, root long, signature binary, members binary"
    )
    more = blocks.groupBy("component", "i", "j").applyInArrow(lambda part: _block_links(part, settings), "a long, b long")
    links = tested.where("linked").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    tied = components(links).join(classes, "node")
    named = tied.groupBy("component").agg(F.min("first").alias("least"))
    names_of = tied.join(named, "component").select("node", "least")
    found = classes.join(names_of, "node", "left").select("node", F.coalesce("least", "first").alias("least"))
    rows = signed.select("id", "n_shingles", "node").join(found, "node", "left")
    least_id = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    return rows.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias(key),
        "n_shingles",
        F.nullif(least_id, F.lit(_NO_ID)).alias("component_id"),
        (F.col("id") == least_id).alias("kept"),
    )
