"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in memory-mapped sorted hash arrays.

Training takes two passes over the texts. The first counts words: every task sums what it has read and sends each shard of
the hash space one packed array. A word's id is its place among all words. The second counts pairs of ids, again as packed
arrays by shard; a pair's key is a one-to-one scrambling of the two ids, so it is exact and spread evenly, and a frequent
word's followers are spread over all shards. Sums per context and per follower then go to the shards of the words. The
driver sees one row per shard and the counts of counts; nothing is pruned, so the model grows with the texts.

Every text is a start mark, its words (runs of other than 0x20, 0x09-0x0D; A-Z lower-cased) and an end, which is scored
like a word. With counts c, discounts D by count (1, 2, 3 or more) and V known tokens:

    p(w | u) = max(c(uw) - D, 0) / c(u) + g(u) p(w);   p(w) = max(k(w) - d, 0) / K + g / (V + 1)

k(w) is the number of different words before w, K their sum; g give each context's discounts back, so all known tokens and
one unknown sum to 1. A context never seen leaves p(w).

A null text counts as empty (only its end is scored); repeated rows count as often as they stand there; without training
texts every token has probability 1 / (V + 1) = 1. Rows keep the named columns; others are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm.store import Store, write_arrays
from logmix.storage import new_folder, stage

END = np.uint64(0xE0D0E0D0E0D0E0D1)
# A task sums and sends what it has read after this many tokens, so its memory is bounded.
FLUSH_TOKENS = 1_500_000


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words and the end of every text, and their number by text."""
    hashes, counts = bt.words(data, offsets)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = bt.raw_texts(batch.column(text))
        for a, b in bt.slices(offsets):
            part = offsets[a : b + 1]
            yield batch.slice(a, b - a), *_tokens(data[part[0] : part[-1]], part - part[0])


def _rows(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    bounds = bt.shard_bounds(keys, shards)
    used = np.flatnonzero(np.diff(bounds))
    blobs = [bt.pack(keys[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]]) for k in used]
    return pa.record_batch([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return bt.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _counted(stream: Iterator[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """Sums of keys, sent in bounded portions."""
    parts, held = [], 0
    for keys in stream:
        parts.append(np.unique(keys, return_counts=True))
        held += len(parts[-1][0])
        if held > FLUSH_TOKENS:
            yield _rows(*_summed(parts), shards)
            parts, held = [], 0
    if held:
        yield _rows(*_summed(parts), shards)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    blobs = [bt.unpack(b, 2) for b in table.column("blob").to_pylist()]
    return bt.summed(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]))


def _discounts(n: Sequence[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of keys with counts 1 to 4."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), float(k)) for k in (1, 2, 3)]


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class LanguageModel:
    words: Store  # hash, count
    pairs: Store  # scrambled pair of ids, count
    contexts: Store  # by id: distinct words before it; followers seen once, twice, more often
    tokens: int  # of training, ends included
    distinct: int
    texts: int
    start: list[int]  # of the start mark: followers seen once, twice, more often
    pair_discounts: list[float]
    word_discounts: list[float]
    spread: list[int]  # words with one, two, more words before them
    before: int  # the sum of words before each word

    def _lower(self, before: np.ndarray) -> np.ndarray:
        rest = 1.0 / (self.distinct + 1)
        if not self.before:
            return np.full(len(before), rest)
        back = sum(d * n for d, n in zip(self.word_discounts, self.spread, strict=True)) / self.before
        d = np.array([0.0, *self.word_discounts])[np.minimum(before, 3)]
        return (before - d) / self.before + back * rest

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Per text: known tokens, the log10 probability under add-one counts, and under the model."""
        wanted, inverse = np.unique(hashes, return_inverse=True)
        place = self.words.places(wanted)
        known = place >= 0
        order = np.argsort(place[known], kind="stable")
        at = place[known][order]
        where = np.flatnonzero(known)[order]
        seen, before, back = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64), np.zeros(len(wanted))
        seen[where] = self.words.at(at, 1)
        before[where] = self.contexts.at(at, 0)
        for k in (1, 2, 3):
            back[where] += self.pair_discounts[k - 1] * self.contexts.at(at, k)
        ids, seen_by = place[inverse], seen[inverse]
        # What stands before each token: the start mark has the id after the last word.
        first = np.cumsum(counts) - counts
        previous = np.concatenate([[0], ids[:-1]])
        previous[first] = self.distinct
        total = np.concatenate([[0], seen_by[:-1]])
        total[first] = self.texts
        mass = np.concatenate([[0.0], back[inverse][:-1]])
        mass[first] = sum(d * n for d, n in zip(self.pair_discounts, self.start, strict=True))
        lower = self._lower(before[inverse])
        p = lower.copy()
        has = total > 0
        p[has] *= mass[has] / total[has]
        both = np.flatnonzero(has & (previous >= 0) & (ids >= 0))
        pairs, back_to = np.unique(_pair(previous[both], ids[both]), return_inverse=True)
        (found,) = self.pairs.lookup(pairs, [0])
        c = found[back_to].astype(np.int64)
        p[both] += np.maximum(c - np.array([0.0, *self.pair_discounts])[np.minimum(c, 3)], 0) / total[both]
        base = np.log10((seen_by + 1) / (self.tokens + self.distinct + 1))
        return [np.add.reduceat(x, first) for x in ((ids >= 0).astype(np.int64), base, np.log10(p))]


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return bt.mix(before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))


def train(texts: DataFrame, text: str = "text", shards: int | None = None) -> LanguageModel:
    """Count the words and pairs of all texts. ``shards`` (by default the shuffle partitions) bounds a task's share."""
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "language-model")
    texts = texts.select(F.col(text).alias("text"))

    def count_words(batches):
        yield from _counted((h for _, h, _ in _slices(batches, "text")), shards)

    def store_words(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        name = write_arrays(folder, [keys.astype("<u8"), counts.astype("<u8")])
        end = np.searchsorted(keys, END)
        ends = int(counts[end]) if end < len(keys) and keys[end] == END else 0
        row = (table.column("shard")[0].as_py(), name, len(keys), int(counts.sum()), ends)
        return pa.table({n: [v] for n, v in zip(("shard", "file", "keys", "tokens", "ends"), row, strict=True)})

    sent = texts.mapInArrow(count_words, "shard long, blob binary").repartition(shards, "shard")
    found = sent.groupBy("shard").applyInArrow(store_words, "shard long, file string, keys long, tokens long, ends long")
    rows = found.collect()  # one per shard
    words = Store(folder, {r["shard"]: r["file"] for r in rows}, shards, ["<u8", "<u8"], {r["shard"]: r["keys"] for r in rows})
    distinct, tokens, documents = (sum(r[c] for r in rows) for c in ("keys", "tokens", "ends"))
    if distinct >= 2**32:
        raise ValueError("more than 2^32 different words")
    kind = "<u4" if tokens < 2**32 else "<u8"

    def pair_keys(hashes, counts):
        wanted, inverse = np.unique(hashes, return_inverse=True)
        ids = words.places(wanted)[inverse]
        previous = np.concatenate([[0], ids[:-1]])
        previous[np.cumsum(counts) - counts] = distinct
        return _pair(previous, ids)

    def count_pairs(batches):
        yield from _counted((pair_keys(h, c) for _, h, c in _slices(batches, "text")), shards)

    def store_pairs(table: pa.Table) -> pa.Table:
        """Write a shard; send what it adds to each context and follower, by the shard of that word."""
        keys, counts = _merge(table)
        name = write_arrays(folder, [keys.astype("<u8"), counts.astype(kind)])
        ids = bt.unmix(keys)
        before, after = (ids >> np.uint64(32)).astype(np.int64), (ids & np.uint64(0xFFFFFFFF)).astype(np.int64)
        once, twice, more = ((counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
        shard = table.column("shard")[0].as_py()
        start = before == distinct
        out = [(shard, name, -1, b"", b"", [*_tally(counts), *(int(x[start].sum()) for x in (once, twice, more))])]
        contexts = bt.summed(before[~start].astype(np.uint64), once[~start], twice[~start], more[~start])
        followers = bt.summed(after.astype(np.uint64), np.ones(len(after), np.int64))
        cuts = [np.searchsorted(x[0], words.base.astype(np.uint64)) for x in (contexts, followers)]
        for k in range(shards):
            (a, b), (c, d) = ((int(x[k]), int(x[k + 1])) for x in cuts)
            if a < b or c < d:
                out.append((shard, "", k, bt.pack(*(x[a:b] for x in contexts)), bt.pack(*(x[c:d] for x in followers)), []))
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), _PAIR_TYPES, strict=True)], ["shard", "file", "of", "contexts", "followers", "n"]
        )

    sent = texts.mapInArrow(count_pairs, "shard long, blob binary").repartition(shards, "shard")
    stored = stage(
        sent.groupBy("shard").applyInArrow(
            store_pairs, "shard long, file string, of long, contexts binary, followers binary, n array<long>"
        ),
        "pairs",
    )
    rows = stored.where("of < 0").select("shard", "file", "n").collect()  # one per shard
    pairs = Store(folder, {r["shard"]: r["file"] for r in rows}, shards, ["<u8", kind])
    n = [sum(r["n"][i] for r in rows) for i in range(7)] if rows else [0] * 7

    def store_contexts(table: pa.Table) -> pa.Table:
        """Dense arrays for the ids of one shard of the words."""
        k = table.column("of")[0].as_py()
        first, size = int(words.base[k]), int(words.base[k + 1] - words.base[k])
        dense = np.zeros((4, size), np.int64)
        for blob in table.column("followers").to_pylist():
            at, v = bt.unpack(blob, 2)
            dense[0][at.astype(np.int64) - first] += v.astype(np.int64)
        for blob in table.column("contexts").to_pylist():
            at, *v = bt.unpack(blob, 4)
            for target, value in zip(dense[1:], v, strict=True):
                target[at.astype(np.int64) - first] += value.astype(np.int64)
        name = write_arrays(folder, [x.astype("<u4" if tokens < 2**32 else "<u8") for x in dense])
        spread = _tally(dense[0])
        return pa.table(
            {
                "of": [k],
                "file": [name],
                "n": pa.array([[*spread, int((dense[0] > 2).sum()), int(dense[0].sum())]], pa.list_(pa.int64())),
            }
        )

    by_word = stored.where("of >= 0").select("of", "contexts", "followers").repartition(shards, "of")
    made = by_word.groupBy("of").applyInArrow(store_contexts, "of long, file string, n array<long>").collect()
    contexts = Store(folder, {r["of"]: r["file"] for r in made}, shards, [kind] * 4, {k: int(words.base[k + 1] - words.base[k]) for k in range(shards)})
    m = [sum(r["n"][i] for r in made) for i in range(6)] if made else [0] * 6
    return LanguageModel(
        words, pairs, contexts, tokens, distinct, documents, n[4:], _discounts(n[:4]), _discounts(m[:4]), [m[0], m[1], m[4]], m[5]
    )


_PAIR_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))


def score(texts: DataFrame, model: LanguageModel, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, per row, ``n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    rows = texts.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text").dtypes)
    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches):
        for batch, hashes, counts in _slices(batches, "_text"):
            known, base, own = model.score(hashes, counts)
            made = [counts, known, np.full(len(counts), model.tokens), base, own, 10 ** (-own / counts)]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in made)], names)

    return rows.mapInArrow(
        run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
