"""Removal of byte strings repeated across documents, by content-defined sampling and look-ups of hashes.

A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a smaller id. This is not
prefix doubling: Spark sorts no (rank, next rank) pairs and reranks nothing in rounds. Sampled positions are told apart by
hashes of what they begin, in three steps, and a position leaves once its hash is unique.

* Only sampled positions carry a rank. Each window of ``length`` bytes is owned by the least hash of its ``gram``-byte
  strings, which depends on the window alone, so equal windows have equal owners. Neighbouring windows with one owner form
  a run (at most 32 windows); there is about one run for every 16 bytes.
* Round 1, offset ``gram``: the owners' hashes are counted; unique ones, nearly all of ordinary text, leave.
* Round 2: a remaining run's whole content is its next rank. Equal contents are one, with the smallest id that holds it.
* Round 3: among different contents with one owner, the windows are ranked at half the length and then by pairs of such
  ranks, to the full length. A window is repeated if one with the same rank lies in a document with a smaller id.

What the rounds leave, one entry per repeated content (the smallest id with it, and which of its windows are repeated there
already), is stored as sorted arrays that the tasks map into memory. The last pass reads the documents once more and looks
up the content of each run: a later document loses the whole run, the first one only the marked windows. So neither texts
nor places are shuffled, a task sends a content once however often it occurs, and a passage found in every document is one
entry per task. Ranks are 64-bit hashes.

Null and empty texts, and texts shorter than ``length``, stay as they are. A row without an id counts as larger than all
others. Repeated rows are rows of one document: they have the same id and lose nothing to each other. Copies with another
id lose all that is long enough. Columns other than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm.store import Store, write_arrays
from logmix.storage import new_folder

LENGTH, GRAM = 50, 20
_RUN = 32  # windows of a run, one bit each
_FINER = 4  # as many shards as there are shuffle partitions, times this, so that one fits a task beside its copies
_NO_ID = np.iinfo(np.int64).max
# A task sends what it has gathered after this many runs.
FLUSH_RUNS = 250_000


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Owner, first window, number of windows, and text of each run; and the prefix sums of the bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, None
    prefix = bt.prefix_hash(data, bt._BYTES)
    grams = (prefix[gram:] - prefix[:-gram]) * bt.powers(len(data))[1][: len(prefix) - gram]
    owner = _least(grams, length - gram + 1)
    # A window is valid if it ends in the text it begins in.
    lengths = np.diff(offsets)
    valid = np.ones(len(data) + 1, bool)
    for back in range(1, length):
        at = offsets[1:] - back
        valid[at[lengths >= back]] = False
    valid = valid[: len(owner)]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
    change &= valid
    first = np.flatnonzero(change)
    if not len(first):
        return np.zeros(0, np.uint64), none, none, none, prefix
    ends = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]])) + 1
    size = ends - first
    pieces = -(-size // _RUN)
    if pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(size, pieces)
        first = np.repeat(first, pieces) + nth * _RUN
        size = np.minimum(whole - nth * _RUN, _RUN)
    return owner[first], first, size, np.searchsorted(offsets, first, "right") - 1, prefix


def _contents(prefix: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    return bt.span_hash(prefix, first, first + size + length - 1)


def _gather(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several spans, end to end."""
    at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return data[at]


def _slices(batches: Iterator[pa.RecordBatch], key: str | None = None):
    for batch in batches:
        data, offsets = bt.raw_texts(batch.column("_text"))
        for a, b in bt.slices(offsets):
            part = offsets[a : b + 1]
            ids = None
            if key:
                ids = batch.column(key).slice(a, b - a).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            yield batch.slice(a, b - a), ids, data[part[0] : part[-1]], part - part[0]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """New ranks from sorted pairs of ranks: equal pairs, equal ranks."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    step = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
    out = np.empty(len(first), np.int64)
    out[order] = step
    return out


def _repeated_windows(text: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Bit masks: which windows of each content occur in a content that a smaller id holds."""
    spans = size + length - 1
    at = np.cumsum(spans) - spans
    prefix = bt.prefix_hash(text, bt._BYTES)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start, holder = np.repeat(at, size) + nth, np.repeat(np.arange(len(size)), size)
    reach = -(-length // 2)
    rank = _ranks(np.zeros(len(start), np.uint64), bt.span_hash(prefix, start, start + reach))
    rest = bt.span_hash(prefix, start + length - reach, start + length)
    often = np.bincount(rank)[rank] > 1  # unique at half the length: no partner
    start, holder, nth, rank, rest = (x[often] for x in (start, holder, nth, rank, rest))
    rank = _ranks(rank, rest)
    owner_id = ids[holder]
    order = np.lexsort((owner_id, rank))
    lead = np.concatenate([[True], rank[order][1:] != rank[order][:-1]]) if len(order) else np.zeros(0, bool)
    least = np.empty(len(order), np.int64)
    least[order] = owner_id[order][lead][np.cumsum(lead) - 1]
    masks = np.zeros(len(size), np.uint64)
    hit = least < owner_id
    np.bitwise_or.at(masks, holder[hit], np.uint64(1) << nth[hit].astype(np.uint64))
    return masks


def repeated_contents(docs: DataFrame, key: str, text: str, length: int, gram: int, shards: int) -> Store:
    """One entry per repeated content of a run: its hash, the smallest id with it, its repeated windows there."""
    folder = new_folder(docs.sparkSession, "repeats")
    finer = shards * _FINER
    texts = docs.select(F.col(text).alias("_text"), F.col(key).alias("_id"))

    def send(keys, counts):
        bounds = bt.shard_bounds(keys, finer)
        used = np.flatnonzero(np.diff(bounds))
        blobs = [bt.pack(keys[bounds[k] : bounds[k + 1]], np.minimum(counts[bounds[k] : bounds[k + 1]], 2)) for k in used]
        return pa.record_batch([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def count_owners(batches):
        parts, held = [], 0
        for _, _, data, offsets in _slices(batches):
            parts.append(np.unique(_runs(data, offsets, length, gram)[0], return_counts=True))
            held += len(parts[-1][0])
            if held > 4 * FLUSH_RUNS:
                yield send(*bt.summed(*(np.concatenate(x) for x in zip(*parts))))
                parts, held = [], 0
        if held:
            yield send(*bt.summed(*(np.concatenate(x) for x in zip(*parts))))

    def store_owners(table: pa.Table) -> pa.Table:
        blobs = [bt.unpack(b, 2) for b in table.column("blob").to_pylist()]
        keys, counts = bt.summed(*(np.concatenate(x) for x in zip(*blobs)))
        return pa.table({"shard": [table.column("shard")[0].as_py()], "file": [write_arrays(folder, [keys[counts > 1]])]})

    sent = texts.mapInArrow(count_owners, "shard long, blob binary").repartition(shards, "shard")
    owners = sent.groupBy("shard").applyInArrow(store_owners, "shard long, file string").collect()  # one per shard
    shared = Store(folder, {r["shard"]: r["file"] for r in owners}, finer, ["<u8"])

    def send_contents(parts):
        owner, content, low, high, size, spans, text = (np.concatenate(x) for x in zip(*parts))
        at = np.cumsum(spans) - spans
        order = np.lexsort((low, content, owner))
        lead = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        high = np.maximum.reduceat(high[order], np.flatnonzero(lead))
        order = order[lead]
        owner = owner[order]
        bounds = bt.shard_bounds(owner, finer)
        used = np.flatnonzero(np.diff(bounds))
        blobs, texts = [], []
        for k in used:
            a, b = bounds[k], bounds[k + 1]
            own = order[a:b]
            blobs.append(bt.pack(owner[a:b], content[own], low[own].view("u8"), high[a:b].view("u8"), size[own]))
            texts.append(bt.zstandard.ZstdCompressor(level=1).compress(_gather(text, at[own], spans[own]).tobytes()))
        return pa.record_batch([pa.array(used, pa.int64()), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], ["shard", "blob", "text"])

    def find_contents(batches):
        parts, held = [], 0
        for _, ids, data, offsets in _slices(batches, "_id"):
            owner, first, size, of, prefix = _runs(data, offsets, length, gram)
            wanted, back = np.unique(owner, return_inverse=True)
            keep = np.flatnonzero((shared.places(wanted) > -1)[back])
            if not len(keep):
                continue
            owner, first, size, of = owner[keep], first[keep], size[keep], of[keep]
            content = _contents(prefix, first, size, length)
            order = np.lexsort((ids[of], content))
            lead = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
            high = np.maximum.reduceat(ids[of][order], lead)
            own = order[lead]
            spans = size[own] + length - 1
            parts.append((owner[own], content[own], ids[of][own], high, size[own], spans, _gather(data, first[own], spans)))
            held += len(own)
            if held > FLUSH_RUNS:
                yield send_contents(parts)
                parts, held = [], 0
        if held:
            yield send_contents(parts)

    def store_contents(table: pa.Table) -> pa.Table:
        blobs = [bt.unpack(b, 5) for b in table.column("blob").to_pylist()]
        owner, content, low, high, size = (np.concatenate(x) for x in zip(*blobs))
        low, high, size = low.view(np.int64), high.view(np.int64), size.astype(np.int64)
        unpacked = (bt.zstandard.ZstdDecompressor().decompress(t) for t in table.column("text").to_pylist())
        text = np.concatenate([np.frombuffer(t, np.uint8) for t in unpacked])
        spans = size + length - 1
        at = np.cumsum(spans) - spans
        order = np.lexsort((low, content, owner))
        lead = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
        high = np.maximum.reduceat(high[order], lead)
        own = order[lead]
        masks = np.zeros(len(own), np.uint64)
        _, group, members = np.unique(owner[own], return_inverse=True, return_counts=True)
        # Different contents under one owner, some in a smaller document than others; whole groups at a time.
        several = np.flatnonzero(members[group] > 1)
        cuts = np.flatnonzero(np.diff(group[several], prepend=-1))
        a = 0
        while a < len(several):
            later = cuts[np.searchsorted(cuts, min(a + 30_000, len(several)))] if a + 30_000 <= (cuts[-1] if len(cuts) else 0) else len(several)
            some = own[several[a:later]]
            masks[several[a:later]] = _repeated_windows(_gather(text, at[some], spans[some]), size[some], low[some], length)
            a = later
        keep = np.flatnonzero((high > low[own]) | (masks > 0))
        out = content[own][keep]
        order = np.argsort(out)
        rows = [out[order], low[own][keep][order], masks[keep][order].astype("<u4")]
        # Contents are looked up by their own hash, so they change shards.
        bounds = bt.shard_bounds(rows[0], finer)
        used = np.flatnonzero(np.diff(bounds))
        packed = [bt.pack(rows[0][bounds[k] : bounds[k + 1]], *(r[bounds[k] : bounds[k + 1]].astype(np.int64).view("u8") for r in rows[1:])) for k in used]
        return pa.table({"shard": pa.array(used, pa.int64()), "blob": pa.array(packed, pa.binary())})

    def store_results(table: pa.Table) -> pa.Table:
        blobs = [bt.unpack(b, 3) for b in table.column("blob").to_pylist()]
        content, low, masks = (np.concatenate(x) for x in zip(*blobs))
        order = np.argsort(content, kind="stable")
        name = write_arrays(folder, [content[order], low[order].view(np.int64), masks[order].astype("<u4")])
        return pa.table({"shard": [table.column("shard")[0].as_py()], "file": [name]})

    sent = texts.mapInArrow(find_contents, "shard long, blob binary, text binary").repartition(shards, "shard")
    ranked = sent.groupBy("shard").applyInArrow(store_contents, "shard long, blob binary").repartition(shards, "shard")
    files = ranked.groupBy("shard").applyInArrow(store_results, "shard long, file string").collect()  # one per shard
    return Store(folder, {r["shard"]: r["file"] for r in files}, finer, ["<u8", "<i8", "<u4"])


def _covered(data, offsets, ids, found: Store, length: int, gram: int) -> np.ndarray:
    """Which bytes of a slice go."""
    steps = np.zeros(len(data) + 1, np.int32)
    _, first, size, of, prefix = _runs(data, offsets, length, gram)
    if len(first):
        wanted, back = np.unique(_contents(prefix, first, size, length), return_inverse=True)
        low, masks = (x[back] for x in found.lookup(wanted, [_NO_ID, 0]))
        own = ids[of]
        whole = np.flatnonzero(own > low)
        np.add.at(steps, first[whole], 1)
        np.add.at(steps, first[whole] + size[whole] + length - 1, -1)
        part = np.flatnonzero((own == low) & (masks > 0))
        for bit in range(_RUN):
            at = first[part[(masks[part] >> np.uint32(bit)) & 1 == 1]] + bit
            np.add.at(steps, at, 1)
            np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    docs: DataFrame,
    key: str,
    text: str,
    keep: Sequence[str],
    length: int = LENGTH,
    gram: int = GRAM,
    shards: int | None = None,
    as_text: bool = False,
) -> DataFrame:
    """The columns ``keep`` and ``n_bytes, n_removed, spans`` (start and end of each removed run) and ``kept``.

    ``kept`` holds the remaining bytes end to end, or with ``as_text`` the text they make: a character of which only a
    part remains goes too, and a text that lost nothing is unchanged (a null one is empty).
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = repeated_contents(docs, key, text, length, gram, shards)
    rows = docs.select(*keep, F.col(text).alias("_text"), F.col(key).alias("_id"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text", "_id").dtypes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, ids, data, offsets in _slices(batches, "_id"):
            gone = _covered(data, offsets, ids, found, length, gram)
            ahead = np.concatenate([[0], np.cumsum(gone)])
            removed = ahead[offsets[1:]] - ahead[offsets[:-1]]
            left = data[~gone].tobytes()
            cut = offsets - ahead[offsets]
            kept = [left[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            if as_text:
                kept = [k.decode("utf-8", "ignore") for k in kept]
            spans = []
            for n, a, b in zip(removed.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if not n:
                    spans.append([])
                    continue
                edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
            made = [pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "n_bytes", "n_removed", "spans", "kept"])

    kind = "string" if as_text else "binary"
    return rows.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept {kind}")
