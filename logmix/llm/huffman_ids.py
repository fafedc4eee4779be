"""Token ids as canonical, length-limited Huffman codes in independent blocks.

Writing: tasks encode whole texts and store the ids once; the ids are counted over all texts; the driver derives the code
lengths (one per id in use, so bounded by the vocabulary) by package-merge; tasks code each row, rows are dealt by ranges of
the key and sorted, and a task strings them together to blocks. Reading: each block stands alone; its header gives every
row's key, number of ids, place, and the bit offset of each ``STRIDE``-th id, so all stretches are decoded side by side,
one table look-up per id and step.

A file set is a folder with two tables: ``codes`` (id, length) and ``blocks`` (part, block, first, n_tokens, data). Blocks
are in ascending order of (part, block), rows inside them in ascending order of the key; ``first`` is the number of ids of
the part before the block. ``data`` holds, all little-endian: the number of rows (u32); per row the key (i64), the number of
ids (u32), the first byte of its code (u64), the number of offsets (u32); the offsets (u32 bits from the row's first byte);
the codes, most significant bit first, each row on a new byte.

A null text counts as empty; every row ends with ``end_id``. Rows with one key are sorted by their codes; a null key sorts
last. Other columns are ignored. An empty table gives files without blocks, which read as no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm.store import find
from logmix.storage import new_folder

LONGEST = 20  # bits of a code
STRIDE = 512  # ids from one offset to the next
BLOCK_IDS = 1 << 16  # a block is closed once it holds as many
_CACHED_WORDS = 1_000_000
_LETTERS = np.arange(97, 123, dtype=np.uint8)
_NO_KEY = np.iinfo(np.int64).max


class TextEncoder:
    """The ids of whole texts by a file of the tokenizers library, without added special tokens.

    ``by_word`` is for tokenizers that drop blanks, so that blank-separated words can be encoded one by one: new words are
    encoded together, parted by a special token, and kept. A text that spells a special token is encoded as it is. Kept words
    are sorted runs of 64-bit hashes, which are not compared again, with places in one array of ids; all words of a slice of
    texts are looked up at once.
    """

    def __init__(self, path: str, by_word: bool = True):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(special.values())
        self.by_word = by_word and bool(special)
        if self.by_word:
            self.separator_id, self.separator = next(iter(special.items()))
        #: Whether an id ends a word.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.is_last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self._forget()

    def _forget(self) -> None:
        #: Runs of sorted hashes, each at least four times as long as the next, with the first id and the number of ids.
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.ids = np.zeros(0, self.kind)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first id of each of some sorted words, -1 where it isn't known, and the number of ids."""
        first, sizes = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, starts, counts in self.runs:
            rest = np.flatnonzero(first < 0)
            at = find(known, keys[rest])
            hit = at >= 0
            first[rest[hit]], sizes[rest[hit]] = starts[at[hit]], counts[at[hit]]
        return first, sizes

    def _keep(self, keys: np.ndarray, made: list[bytes]) -> None:
        sizes = np.array(list(map(len, made)), np.int64) // self.kind.itemsize
        run = (keys, len(self.ids) + np.cumsum(sizes) - sizes, sizes)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), self.kind)])
        while self.runs and 4 * len(run[0]) > len(self.runs[-1][0]):
            both = [np.concatenate(x) for x in zip(self.runs.pop(), run)]
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self.runs.append(run)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _cut(self, words: list[bytes], size: int, joint: str, ends: Callable[[np.ndarray], np.ndarray], width: int) -> list[bytes] | None:
        """The ids of words that are encoded ``size`` together, cut at the places that ``ends`` finds; None if they don't fit."""
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        texts = [joint.join(w.decode() for w in part) for part in parts]
        out: list[bytes] = []
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            cuts = ends(ids)
            if len(cuts) != len(part):
                return None
            raw, at = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + width * self.kind.itemsize for x in at)], at)]
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words. Those of letters alone are joined by blanks, as each ends with a marked piece; others by a special token."""
        is_plain = [w.decode().lower().isalpha() for w in words]
        plain = [w for w, x in zip(words, is_plain) if x]
        other = [w for w, x in zip(words, is_plain) if not x]
        marked = lambda ids: np.flatnonzero(self.is_last[ids]) + 1
        parted = lambda ids: np.append(np.flatnonzero(ids == self.separator_id), len(ids))
        made = self._cut(plain, 128, " ", marked, 0) or self._cut(plain, 32, self.separator, parted, 1)
        of_plain, of_other = iter(made), iter(self._cut(other, 32, self.separator, parted, 1))
        return [next(of_plain if x else of_other) for x in is_plain]

    def _by_word(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts without special tokens, with blanks for line ends."""
        sizes = np.array(list(map(len, raw)), np.int64)
        offsets, whole = np.concatenate([[0], np.cumsum(sizes)]), b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        inside = data != 32
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        closes[:-1] &= ~inside[1:] | cut[1:-1]
        # A full stop or comma behind a letter, at the end of a word, is a token of its own.
        stops = np.flatnonzero(closes & ~begins & ((data == 46) | (data == 44)))
        stops = stops[np.isin(data[stops - 1] | 32, _LETTERS)]
        begins[stops] = closes[stops - 1] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        hashes = bt.span_hash(bt.prefix_hash(data, bt._BYTES), starts, ends)
        keys, at, own = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(len(r[0]) for r in self.runs) > _CACHED_WORDS:
            self._forget()
        first, counts = self._find(keys)
        if len(new := np.flatnonzero(first < 0)):
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist())
            self._keep(keys[new], self._learn([whole[a:b] for a, b in spans]))
            first, counts = self._find(keys)
        counts = counts[own]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(first[own] - bounds[:-1], counts) + np.arange(bounds[-1])].tobytes()
        bounds = (bounds[np.searchsorted(starts, offsets)] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        raw = [t.encode() for t in texts]
        raw = [(x.lower() if self.lowers else x).replace(b"\n", b" ") for x in raw]
        special = [s.encode() for s in self.special]
        # Lower-casing may spell a special token, too.
        odd = [any(s in x for s in special) or any(s in t for s in self.special) for x, t in zip(raw, texts)]
        rest = iter(self._by_word([x for x, is_odd in zip(raw, odd) if not is_odd]))
        return [self._whole(t) if is_odd else next(rest) for t, is_odd in zip(texts, odd)]


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def _encoder(path: str, by_word: bool) -> TextEncoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = TextEncoder(path, by_word)
    return _encoders[path, by_word]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code with codes of at most ``longest`` bits, by package-merge. Counts are positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_leaf.append(at < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(self.lengths.max()) if len(order) else 1
        # In units of the longest code, each code begins where the one before ends.
        spans = 1 << (self.longest - self.lengths)
        begins = np.cumsum(spans) - spans
        self.codes = begins >> (self.longest - self.lengths)

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids], lengths[self.ids] = self.codes.astype(np.uint64), self.lengths
        return codes, lengths

    def table(self) -> np.ndarray:
        """For every ``longest`` bits that may follow: id and length of the code they begin with."""
        return np.repeat((self.ids << 5 | self.lengths).astype(np.int64), 1 << (self.longest - self.lengths))


def encode_rows(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The codes of several rows, each from a new byte on: the bytes, each row's first byte, each id's first bit."""
    bits = lengths[ids]
    ahead = np.cumsum(bits) - bits
    last = np.cumsum(sizes)
    first = last - sizes
    row_bits = np.add.reduceat(bits, first)
    row_bytes = -(-row_bits // 8)
    begins = np.cumsum(row_bytes) - row_bytes
    at = ahead + np.repeat(begins * 8 - ahead[first], sizes)
    word, free = at >> 6, 64 - (at & 63) - bits
    value = codes[ids]
    out = np.zeros(int(row_bytes.sum()) // 8 + 2, np.uint64)
    high = np.where(free >= 0, value << np.maximum(free, 0).astype(np.uint64), value >> np.maximum(-free, 0).astype(np.uint64))
    lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[lead]] = np.bitwise_or.reduceat(high, lead)
    over = np.flatnonzero(free < 0)
    out[word[over] + 1] |= value[over] << (64 + free[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(row_bytes.sum())], begins, at


def decode_lanes(data: np.ndarray, start: np.ndarray, count: np.ndarray, table: np.ndarray, longest: int) -> np.ndarray:
    """The ids of many stretches, one after the other: ``count`` codes from bit ``start`` on each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    order = np.argsort(-count, kind="stable")
    at, left = start[order].astype(np.int64), count[order]
    begins = (np.cumsum(count) - count)[order]
    out = np.empty(int(count.sum()), np.int64)
    running = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")  # lanes with more than k codes
    # Up to 25 bits can be read from any bit of a 32-bit window.
    for k, n in enumerate(running.tolist()):
        bit = at[:n]
        found = table[(window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - longest)]
        out[begins[:n] + k] = found >> 5
        bit += found & 31
    return out


def write_ids(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str, by_word: bool = True) -> None:
    """Encode every row's whole text and write the file set to ``folder``, in ascending order of the key."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("key"), F.col(text).alias("text"))
    scratch = new_folder(spark, "ids")

    def encode(batches):
        encoder = _encoder(tokenizer, by_word)
        end = np.array([end_id], encoder.kind).tobytes()
        counts = np.zeros(1, np.int64)
        for batch in batches:
            _, offsets = bt.raw_texts(batch.column("text"))
            for a, b in bt.slices(offsets):
                texts = [x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]
                made = [x + end for x in encoder.encode(texts)]
                found = np.bincount(np.frombuffer(b"".join(made), encoder.kind))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[: len(found)] += found
                none = pa.nulls(b - a, pa.int64())
                yield pa.record_batch([batch.column("key").slice(a, b - a), pa.array(made, pa.binary()), none, none], _ENCODED)
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used))
        yield pa.record_batch([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used), pa.array(counts[used])], _ENCODED)

    encoded = rows.mapInArrow(encode, "key long, ids binary, id long, n long")
    encoded.write.option("compression", "zstd").parquet(scratch)
    stored = spark.read.parquet(scratch)
    counts = stored.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()  # the vocabulary
    ids = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64))
    table = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length int")
    table.coalesce(1).write.parquet(f"{folder}/codes")
    by_id = Code(ids, lengths).by_id()
    kind = TextEncoder(tokenizer).kind
    data = stored.where("id is null").select("key", "ids")
    # Ranges of about equal numbers of rows; a key's rows share a range.
    bounds = data.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def code(batches):
        for batch in batches:
            raw = batch.column("ids")
            sizes = np.array([len(x) for x in raw.to_pylist()], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in bt.slices(offsets):
                own = sizes[a:b] // kind.itemsize
                tokens = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), kind).astype(np.int64)
                made, begins, at = encode_rows(tokens, own, *by_id)
                ends = [*begins[1:].tolist(), len(made)]
                first = np.cumsum(own) - own
                marks = [(at[f : f + n : STRIDE] - 8 * s).astype("<u4").tobytes() for f, n, s in zip(first.tolist(), own.tolist(), begins.tolist())]
                keys = batch.column("key").slice(a, b - a)
                part = np.searchsorted(bounds, keys.to_numpy(), "right")
                coded = [made[x:y] for x, y in zip(begins.tolist(), ends)]
                yield pa.record_batch([pa.array(part), keys, pa.array(own), pa.array(marks, pa.binary()), pa.array(coded, pa.binary())], _CODED)

    coded = data.mapInArrow(code, "part long, key long, n long, marks binary, code binary")
    dealt = coded.repartition(parts, "part").sortWithinPartitions("part", "key", "code")

    def block(batches):
        held, size, place, nth, first = [], 0, None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != place or size >= BLOCK_IDS):
                    yield _block(held, place, nth, first, size)
                    nth, first, held, size = nth + 1, first + size, [], 0
                if row[0] != place:
                    place, nth, first = row[0], 0, 0
                held.append(row)
                size += row[2]
        if held:
            yield _block(held, place, nth, first, size)

    blocks = dealt.mapInArrow(block, "part long, block long, first long, n_tokens long, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


_ENCODED = ["key", "ids", "id", "n"]
_CODED = ["part", "key", "n", "marks", "code"]
_HEAD = np.dtype([("key", "<i8"), ("n", "<u4"), ("byte", "<u8"), ("marks", "<u4")])


def _block(rows: list[tuple], part: int, nth: int, first: int, size: int) -> pa.RecordBatch:
    head = np.zeros(len(rows), _HEAD)
    head["key"], head["n"] = [r[1] for r in rows], [r[2] for r in rows]
    lengths = np.array([len(r[4]) for r in rows])
    head["byte"], head["marks"] = np.cumsum(lengths) - lengths, [len(r[3]) // 4 for r in rows]
    data = b"".join([np.array([len(rows)], "<u4").tobytes(), head.tobytes(), *(r[3] for r in rows), *(r[4] for r in rows)])
    columns = [pa.array([x], pa.int64()) for x in (part, nth, first, size)]
    return pa.record_batch([*columns, pa.array([data], pa.binary())], ["part", "block", "first", "n_tokens", "data"])


def _open(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Header, offsets and codes of a block."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, _HEAD, n, 4)
    at = 4 + n * _HEAD.itemsize
    marks = np.frombuffer(data, "<u4", int(head["marks"].sum()), at)
    return head, marks, np.frombuffer(data, np.uint8, offset=at + marks.nbytes)


def _decoded(blocks: list[bytes], table: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Headers and ids of some blocks, decoded together."""
    opened = [_open(b) for b in blocks]
    at = np.cumsum([0, *(len(o[2]) for o in opened)])
    start, count = [], []
    for (head, marks, _), base in zip(opened, at.tolist()):
        n, own = head["n"].astype(np.int64), head["marks"].astype(np.int64)
        nth = np.arange(len(marks)) - np.repeat(np.cumsum(own) - own, own)
        start.append(np.repeat(8 * (head["byte"].astype(np.int64) + base), own) + marks)
        count.append(np.minimum(np.repeat(n, own) - nth * STRIDE, STRIDE))
    ids = decode_lanes(np.concatenate([o[2] for o in opened]), np.concatenate(start), np.concatenate(count), table, longest)
    done = 0
    for head, _, _ in opened:
        size = int(head["n"].sum())
        yield head, ids[done : done + size]
        done += size


def read_ids(spark: SparkSession, folder: str, key: str = "key", digest: bool = False) -> DataFrame:
    """``(key, start, n_tokens, ids)`` of every row; with ``digest`` the CRC-32 of its ids as 32-bit numbers instead."""
    codes = spark.read.schema("id long, length int").parquet(f"{folder}/codes").collect()  # the vocabulary
    code = Code(np.array([r["id"] for r in codes], np.int64), np.array([r["length"] for r in codes], np.int64))
    blocks = spark.read.schema("part long, block long, first long, n_tokens long, data binary").parquet(f"{folder}/blocks")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    ahead, before = {}, 0
    for part in sorted(totals):
        ahead[part], before = before, before + totals[part]
    schema = f"`{key}` long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")

    def run(batches):
        table = code.table()
        for batch in batches:
            for a in range(0, len(batch), 16):
                some = batch.slice(a, 16)
                firsts = [ahead[p] + f for p, f in zip(some.column("part").to_pylist(), some.column("first").to_pylist())]
                for first, (head, ids) in zip(firsts, _decoded(some.column("data").to_pylist(), table, code.longest)):
                    n = head["n"].astype(np.int64)
                    ends = np.cumsum(n)
                    raw = ids.astype("<u4")
                    if digest:
                        view = memoryview(raw.tobytes())
                        values = pa.array([zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64())
                    else:
                        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(raw.astype(np.int32)))
                    keys = pa.array(head["key"], mask=head["key"] == _NO_KEY)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(first + ends - n), pa.array(n), values], names)

    names = [key, "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return blocks.select("part", "first", "data").mapInArrow(run, schema)
