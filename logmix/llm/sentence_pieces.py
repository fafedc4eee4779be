"""SentencePiece encoding and decoding over a relational lattice.

The texts' distinct words are a table. Their substrings of bounded length are exploded and equi-joined to the table of
pieces; the edges so found are grouped by word, and a higher-order ``aggregate`` folds each word's edges to its pieces:

* for a unigram model by Viterbi: the best sum of scores up to each character (ties: the longest last piece), in 32-bit
  floats and with the score of an unknown character as the library has them;
* for a BPE model by its merges: the best-scored neighbouring pair whose join is an edge (ties: the leftmost) becomes one, as
  often as there is one. Viterbi doesn't give a BPE model's ids, since it weighs whole sums.

Words are cut where no piece can cross: before a run of blanks and around line ends. The pieces of each word are stored as
sorted hash arrays that tasks map into memory to encode the texts, so texts are never shuffled. A word of more than
``LONGEST`` characters is folded in the task that reads it, by the same rules, since its edges would be one large group.

Models must keep their input (identity normalisation, blanks kept, no piece across a blank) and fall back to bytes or to the
unknown piece. As in the library, a non-empty text gets a blank in front, a blank is U+2581, and decoding turns that back: a
text comes back as it was, but for U+2581 itself, which becomes a blank. A null text is empty and has no ids. Repeated rows
are encoded alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm.store import BlobStore, build_blobs, find

BLANK = "▁"
LONGEST = 60  # the places of a word are bits of a number
_BLANK_BYTES = tuple(BLANK.encode())
_SLICE_BYTES = bt.SLICE_BYTES
_SEEN_WORDS = 1_000_000  # that a task remembers to have sent
_PARTS = 4  # times the shuffle partitions: each word makes dozens of rows
_UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: id and score by text, ids of single bytes, text by id."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    surface: list[bytes]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @property
    def unknown_score(self) -> float:
        return float(np.float32(min(self.scores.values())) - np.float32(_UNKNOWN_PENALTY))


def load(path: str) -> Pieces:
    import sentencepiece

    with open(path, "rb") as file:
        model = dict(_fields(raw := file.read()))
    kind = dict(_fields(model[2])).get(3, UNIGRAM)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids, scores, byte_ids, surface = {}, {}, [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids.append(i)
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i):
            surface.append(b"")
        elif sp.is_unknown(i):
            surface.append(" ⁇ ".encode())
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            surface.append(piece.replace(BLANK, " ").encode())
    if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in ids):
        raise ValueError("the model has pieces across blanks or line ends")
    return Pieces(kind, ids, scores, byte_ids, sp.unk_id(), surface)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given spans one behind the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


@dataclass(frozen=True)
class Words:
    """The words of a slice of texts, with each blank as one byte 0x20: bytes, spans and hashes; ``texts`` bounds each text's."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes().decode().replace(" ", BLANK)


def cut_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Cut texts (UTF-8 bytes, end to end) into words; a non-empty text gets a blank in front."""
    first, second, third = _BLANK_BYTES
    marks = np.flatnonzero((data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third)) if len(data) > 2 else np.zeros(0, int)
    if len(marks):  # the sign for a blank, in a text, is a blank
        keep = np.ones(len(data), bool)
        keep[marks + 1] = keep[marks + 2] = False
        data = data.copy()
        data[marks] = 32
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    blank, end = data == 32, data == 10
    # A line end is a word; others begin at a text, behind a line end, and at the first of a run of blanks.
    begins = end | blank
    begins[1:] &= end[1:] | ~blank[:-1]
    begins[1:] |= end[:-1]
    begins[offsets[:-1][filled]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    hashes = bt.span_hash(bt.prefix_hash(data, bt._BYTES), starts, ends) if len(data) else np.zeros(0, np.uint64)
    return Words(data, starts, ends - starts, hashes, np.searchsorted(starts, offsets))


def _words_of(texts: DataFrame) -> DataFrame:
    """``(word, key)``: distinct words (of bounded length) of the column ``_text`` and their hashes, in more partitions than
    their few bytes would ask for."""
    parts = _PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = bt.raw_texts(batch.column("_text"))
            for a, b in bt.slices(offsets, _SLICE_BYTES):
                words = cut_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys, at = np.unique(words.hashes, return_index=True)
                fresh = find(sent, keys) < 0
                keys, at = keys[fresh], at[fresh]
                sent = np.insert(sent, np.searchsorted(sent, keys), keys) if len(sent) < _SEEN_WORDS else keys
                letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                short = letters[words.starts[at] + words.sizes[at]] - letters[words.starts[at]] <= LONGEST
                keys, at = keys[short], at[short]
                raw, bounds = _gather(words.data, words.starts[at], words.sizes[at])
                text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([text, pa.array(keys.view(np.int64))], ["word", "key"])

    # The partitioning by word holds up to the lattice's groups, so it comes after the last change to the word.
    found = texts.mapInArrow(cut, "word string, key long").select(F.translate("word", " ", BLANK).alias("word"), "key")
    return found.repartition(parts, "word").distinct()


# A BPE edge is one number: rank, start, end, whether its piece may be late, and id, from the highest bits. So edges sort by
# rank, then from the left.
_RANK_AT, _START_AT, _END_AT, _LATE_AT, _ID_BITS = 40, 32, 24, 23, 23
_PAGE = 8  # bits of a code point within a page of the table of characters


def _start(edge: Column) -> Column:
    return F.shiftright(edge, _START_AT).bitwiseAND(F.lit(255)).cast("int")


def _end(edge: Column) -> Column:
    return F.shiftright(edge, _END_AT).bitwiseAND(F.lit(255)).cast("int")


def _id(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _bits(start: Column, end: Column) -> tuple[Column, Column]:
    """An edge's two bounds, and the places between, as bits."""
    return _bit(start).bitwiseOR(_bit(end)), _bit(end) - _bit(start + 1)


def _late(pieces: Pieces) -> set[str]:
    """The pieces that are one part of a piece with no worse a score: once they are merged, that one may come next, although
    its turn by rank is over."""
    found = set()
    for whole, score in pieces.scores.items():
        for k in range(1, len(whole)):
            parts = whole[:k], whole[k:]
            if all(len(x) == 1 or x in pieces.scores for x in parts):
                found.update(x for x in parts if len(x) > 1 and pieces.scores[x] <= score)
    return found


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word, key, edges)``: the pieces in each word. For a BPE model an edge is a packed number, best-scored first, and pieces
    of one character, which no merge makes, are left out; for a unigram model it has start, end, score and id.

    Characters are counted from 0. A word without any edge has no row.
    """
    least = 2 if pieces.kind == BPE else 1
    ranks = {score: k for k, score in enumerate(sorted(set(pieces.scores.values()), reverse=True))}
    late = _late(pieces) if pieces.kind == BPE else set()
    rows = [(p, i, pieces.scores[p], ranks[pieces.scores[p]], int(p in late)) for p, i in pieces.ids.items() if len(p) >= least]
    table = words.sparkSession.createDataFrame(rows, "known string, id long, score float, rank long, late int")
    # A hash is a shorter key than text; the texts are compared where the hashes agree. That comparison is no equality of columns,
    # which would make the text part of the key of the join again.
    table = table.withColumn("hash", F.xxhash64("known")).withColumn("bytes", F.octet_length("known"))
    n = F.length("word")
    starts = words.where(n >= least).select("word", "key", F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    reach = F.least(F.lit(pieces.longest), n - F.col("start"))
    sizes = starts.select("word", "key", "start", F.explode(F.sequence(F.lit(least), reach)).alias("size"))
    parts = sizes.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("size")))
    parts = parts.withColumn("hash", F.xxhash64("piece"))
    is_known = F.startswith("piece", "known") & (F.octet_length("piece") <= F.col("bytes"))
    # The vocabulary bounds the table of pieces.
    joined = parts.join(F.broadcast(table), (parts["hash"] == table["hash"]) & is_known)
    end = F.col("start") + F.col("size")
    if pieces.kind == UNIGRAM:
        edge = F.struct("start", end.alias("end"), "score", F.col("id").cast("int").alias("id"))
    else:
        fields = (("rank", _RANK_AT), ("start", _START_AT), (end, _END_AT), ("late", _LATE_AT), ("id", 0))
        edge = reduce(Column.bitwiseOR, [F.shiftleft((F.col(c) if isinstance(c, str) else c).cast("long"), n) for c, n in fields])
    return joined.groupBy("word", "key").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _viterbi(word: Column, edges: Column, unknown: float) -> Column:
    """Starts of the pieces of the best path, in reverse, as a fold over the ends; state: (score, start) by character."""
    zero = F.array(F.struct(F.lit(0.0).cast("float").alias("score"), F.lit(-1).alias("start")))

    def step(state: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == end)
        known = F.transform(into, lambda e: F.struct((state[e["start"]]["score"] + e["score"]).alias("score"), e["start"].alias("start")))
        single = F.exists(into, lambda e: e["start"] == end - 1)
        alone = F.array(F.struct((state[end - 1]["score"] + F.lit(unknown).cast("float")).alias("score"), (end - 1).alias("start")))
        ways = F.when(single, known).otherwise(F.concat(known, alone))
        best = F.array_max(F.transform(ways, lambda w: F.struct(w["score"].alias("score"), (-w["start"]).alias("back"))))
        return F.concat(state, F.array(F.struct(best["score"].alias("score"), (-best["back"]).alias("start"))))

    states = F.aggregate(F.sequence(F.lit(1), F.length(word)), zero, step)

    def walk(bounds: Column, states: Column) -> Column:
        last = bounds[0]
        return F.when(last > 0, F.concat(F.array(states[last]["start"]), bounds)).otherwise(bounds)

    back = lambda s: F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.length(word)), lambda b, _: walk(b, s))
    return F.transform(F.array(states), back)[0]


def _merges(word: Column, marks: Column) -> Column:
    """The bounds of the pieces after all merges, one bit each.

    A pair can be merged if both ends of an edge are bounds and just one lies inside; a merge takes that one out. One pass over
    the edges in order of rank and place makes all merges, unless a merge lets an earlier edge in. Only a late piece can; such
    a word, a negative state, starts again and looks for the first edge that fits in each step.
    """
    zero = F.expr("shiftleft(1L, length(word) + 1) - 1L")
    fits = lambda s, e: (s.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(s.bitwiseAND(e["inside"])) == 1)
    merged = lambda s, e: s.bitwiseAND(F.bitwise_not(e["inside"]))

    def once(state: Column, edge: Column) -> Column:
        is_late = F.shiftright(edge["edge"], _LATE_AT).bitwiseAND(F.lit(1)) == 1
        back = is_late & F.exists(marks, lambda e: (e["edge"] < edge["edge"]) & fits(merged(state, edge), e))
        return F.when((state > 0) & fits(state, edge), F.when(back, F.lit(-1).cast("long")).otherwise(merged(state, edge))).otherwise(state)

    def step(state: Column) -> Column:
        first = F.get(F.filter(marks, lambda e: fits(state, e)), F.lit(0))["inside"]
        return F.when(state < 0, state).otherwise(F.coalesce(state.bitwiseAND(F.bitwise_not(first)), -state))

    steps = F.aggregate(F.sequence(F.lit(1), F.length(word)), zero, lambda s, _: step(s), F.abs)
    return F.aggregate(marks, zero, once, lambda s: F.when(s > 0, s).otherwise(steps))


def _alone(pieces: Pieces, char: Column) -> Column:
    """The id of a piece of one character; -1 or null if there is none. A table of pages of code points has the ids."""
    known = {ord(p): i for p, i in pieces.ids.items() if len(p) == 1}
    pages = sorted({c >> _PAGE for c in known})
    first = {page: k << _PAGE for k, page in enumerate(pages)}
    listed = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
    places = listed([first.get(page, -(1 << _PAGE)) for page in range(max(pages, default=0) + 1)])
    ids = listed([known.get((page << _PAGE) + k, -1) for page in pages or [0] for k in range(1 << _PAGE)])
    code = F.ascii(char)
    place = F.get(places, F.shiftright(code, _PAGE)) + code.bitwiseAND(F.lit((1 << _PAGE) - 1))
    return F.get(ids, place)


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """``(key, ids)`` from the lattice."""
    if pieces.kind == UNIGRAM:
        places = _viterbi(F.col("word"), F.col("edges"), pieces.unknown_score)
        bits = F.aggregate(places, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(_bit(b)))
        start, end, number = (lambda e: e["start"]), (lambda e: e["end"]), (lambda e: e["id"])
    else:
        bits = _merges(F.col("word"), F.col("marks"))
        start, end, number = _start, _end, _id

    def mark(edge: Column) -> Column:
        ends, inside = _bits(start(edge), end(edge))
        return F.struct(edge.alias("edge"), ends.alias("ends"), inside.alias("inside"))

    # Each edge's bits are made once: this selection's columns are used several times, so it is not merged with the next.
    marked = edges.select("word", "key", "edges", F.transform("edges", mark).alias("marks"))
    cut = marked.select("word", "key", "marks", bits.alias("bits"))

    def on_path(mark: Column) -> Column:
        return (F.col("bits").bitwiseAND(mark["ends"]) == mark["ends"]) & (F.col("bits").bitwiseAND(mark["inside"]) == 0)

    # The pieces on the path, in their order in the word: start and id in one number.
    placed = lambda m: F.shiftleft(start(m["edge"]).cast("long"), _ID_BITS).bitwiseOR(number(m["edge"]).cast("long"))
    cut = cut.select("word", "key", "bits", F.sort_array(F.transform(F.filter("marks", on_path), placed)).alias("path"))
    if pieces.kind == BPE:
        both = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(3)) == 3
        single = lambda i: F.shiftleft(i.cast("long"), _ID_BITS).bitwiseOR(_alone(pieces, F.substring("word", i + 1, F.lit(1))).cast("long"))
        singles = F.transform(F.filter(F.sequence(F.lit(0), F.length("word") - 1), both), single)
        known = F.sort_array(F.concat("path", F.filter(singles, lambda x: x >= 0)))
        cut = cut.withColumn("path", F.when(F.size("path") == F.bit_count("bits") - 1, F.col("path")).otherwise(known))

    def spelled(place: Column) -> Column:
        """The id of the piece at a place, or those of an unknown character."""
        own = F.filter("path", lambda e: F.shiftright(e, _ID_BITS).cast("int") == place)
        if not pieces.byte_ids:
            return F.array(F.coalesce(_id(F.get(own, F.lit(0))), F.lit(pieces.unknown)))
        digits = F.hex(F.encode(F.substring(F.col("word"), place + 1, F.lit(1)), "UTF-8"))
        byte_ids = F.array(*map(F.lit, pieces.byte_ids))
        as_bytes = F.transform(
            F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")),
            lambda k: byte_ids[F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int")],
        )
        return F.when(F.size(own) > 0, F.transform(own, _id)).otherwise(as_bytes)

    is_bound = lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0
    starts = F.filter(F.sequence(F.lit(0), F.length("word") - 1), is_bound)
    whole = F.size("path") == F.bit_count("bits") - 1
    ids = F.when(whole, F.transform("path", _id)).otherwise(F.flatten(F.transform(starts, spelled)))
    return cut.select("key", ids.alias("ids"))


def fold_long(word: str, pieces: Pieces) -> list[int]:
    """The ids of one long word, by the same rules, with memory in proportion to its length."""
    if pieces.kind == UNIGRAM:
        best, start = np.full(len(word) + 1, -np.inf, np.float32), [0] * (len(word) + 1)
        best[0] = 0
        unknown = np.float32(pieces.unknown_score)
        for a in range(len(word)):
            for b in range(a + 1, min(a + pieces.longest, len(word)) + 1):
                score = pieces.scores.get(word[a:b])
                score = unknown if score is None and b == a + 1 else score
                if score is not None and best[a] + np.float32(score) > best[b]:
                    best[b], start[b] = best[a] + np.float32(score), a
        cuts = [len(word)]
        while cuts[-1] > 0:
            cuts.append(start[cuts[-1]])
        cuts.reverse()
    else:
        after = list(range(1, len(word) + 1)) + [len(word) + 1]
        before = list(range(-1, len(word)))
        alive = [True] * len(word)
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < len(word) and (joined := word[a : after[after[a]]]) in pieces.ids:
                heapq.heappush(heap, (-pieces.scores[joined], a, after[after[a]]))

        for a in range(len(word) - 1):
            offer(a)
        while heap:
            _, a, end = heapq.heappop(heap)
            if alive[a] and after[a] < len(word) and after[after[a]] == end:
                alive[after[a]] = False
                after[a] = end
                if end < len(word):
                    before[end] = a
                offer(a)
                offer(before[a])
        cuts = [a for a in range(len(word)) if alive[a]] + [len(word)]
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        piece = word[a:b]
        known = pieces.ids.get(piece)
        out += [known] if known is not None else [pieces.byte_ids[x] for x in piece.encode()] or [pieces.unknown] if pieces.byte_ids else [pieces.unknown]
    return out


def _encoded(words: Words, store: BlobStore, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice of texts, and their bounds by text."""
    keys, at, own = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw, sizes = store.get_arrays(keys)
    known, sizes = raw.view("<i4"), sizes // 4
    missing = np.flatnonzero(sizes < 0)
    sizes[missing] = 0
    starts = np.cumsum(sizes) - sizes
    if len(missing):
        # Long words, and those without any piece.
        made = [np.array(fold_long(words.text(k), pieces), "<i4") for k in at[missing]]
        sizes[missing] = list(map(len, made))
        starts[missing] = len(known) + np.cumsum(sizes[missing]) - sizes[missing]
        known = np.concatenate([known, *made])
    ids, bounds = _gather(known, starts[own], sizes[own])
    return ids, bounds[words.texts]


def _encoder(store: BlobStore, pieces: Pieces, text: str, keep: Sequence[str]):
    """What a task does to encode batches."""

    def run(batches):
        for batch in batches:
            data, offsets = bt.raw_texts(batch.column(text))
            for a, b in bt.slices(offsets, _SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids, bounds = _encoded(cut_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), store, pieces)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], [*keep, "ids"])

    return run


def _decoder(pieces: Pieces, ids: str, keep: Sequence[str], text: str):
    """What a task does to decode batches."""
    surface = np.frombuffer(b"".join(pieces.surface), np.uint8)
    sizes = np.array(list(map(len, pieces.surface)))
    places = np.cumsum(sizes) - sizes

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, before = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
            for a, b in bt.slices(before, _SLICE_BYTES // 4):
                here = flat[before[a] : before[b]]
                if len(here) and (here.min() < 0 or here.max() >= len(sizes)):
                    raise ValueError("an id that the model does not have")
                data, bounds = _gather(surface, places[here], sizes[here])
                bounds = bounds[before[a : b + 1] - before[a]]
                # The blank in front of a text goes.
                opened = bounds[:-1][np.diff(bounds) > 0]
                opened = opened[data[opened] == 32]
                gone = np.zeros(len(data) + 1, np.int64)
                gone[opened + 1] = 1
                data, bounds = np.delete(data, opened), bounds - np.cumsum(gone)[bounds]
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
                try:
                    texts = raw.cast(pa.string())
                except pa.ArrowInvalid:  # bytes that are no text
                    texts = pa.array([t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], [*keep, text])

    return run


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)


def _prepared(docs: DataFrame, text: str, keep: Sequence[str], pieces: Pieces) -> tuple[DataFrame, str, BlobStore]:
    """The rows with the columns ``keep`` and their text, the name of its column, and the pieces of all words."""
    # A text that is kept anyway travels once.
    own = text if text in keep else "_text"
    rows = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")]))
    words = _words_of(rows.select(F.col(own).alias("_text")))
    return rows, own, build_blobs(fold(lattice(words, pieces), pieces), "key", "ids", "words")


def encode(docs: DataFrame, text: str, keep: Sequence[str], model: str, pieces: Pieces | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids array<int>`` of every row."""
    pieces = pieces or load(model)
    rows, own, store = _prepared(docs, text, keep, pieces)
    return rows.mapInArrow(_encoder(store, pieces, own, keep), f"{_ddl(rows.select(*keep))}, ids array<int>")


def decode(rows: DataFrame, ids: str, keep: Sequence[str], model: str, pieces: Pieces | None = None) -> DataFrame:
    """The columns ``keep`` and ``text``, what the ids stand for; ids that the model does not have are an error."""
    pieces = pieces or load(model)
    rows = rows.select(*keep, F.col(ids).alias("_ids"))
    return rows.mapInArrow(_decoder(pieces, "_ids", keep, "text"), f"{_ddl(rows.drop("_ids"))}, text string")


def encode_and_decode(docs: DataFrame, text: str, keep: Sequence[str], model: str, pieces: Pieces | None = None) -> DataFrame:
    """The columns ``keep``, ``ids``, and ``decoded``, as ``decode`` makes it from the ids alone.

    Both run in one Python process for each task, slice by slice; as two steps, a task holds two processes, and all ids cross
    the JVM between them.
    """
    pieces = pieces or load(model)
    rows, own, store = _prepared(docs, text, keep, pieces)
    encoder, decoder = _encoder(store, pieces, own, keep), _decoder(pieces, "ids", [*keep, "ids"], "decoded")
    return rows.mapInArrow(lambda batches: decoder(encoder(batches)), f"{_ddl(rows.select(*keep))}, ids array<int>, decoded string")
