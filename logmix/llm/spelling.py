"""Groups spelling variants with bidirectional FM-index search schemes over the vocabulary.

Two words are near if they differ by just one inserted, deleted or replaced code point. The words are cut in halves, and one
error leaves one half as it is. So there are two searches, one from either end of a word:

* the left half exactly, then rightwards across the other half, allowing one error there;
* the right half exactly, then leftwards across the other half, with one error there.

Each runs on an FM-index of the delimited vocabulary ``$word$word$…``, in one direction on the text and in the other on its
reversal. The search keeps intervals of suffix ranks: it begins with all delimiters, narrows the interval letter by letter,
branches where it spends the error (over the letters that the interval holds, or the alphabet if that is smaller), and ends
with a delimiter. Since words are sorted, the rank of a delimiter's suffix is its word's number. A pair that both searches
would find is left to the first.

Spark builds the index in shards. A word goes, for each direction, to the shards of its halves, as long as a word that is near it may cut them (two
lengths), and it asks the shard of its own half. So a search meets all words that share its exact half, every
shard is of bounded size, and no pairs are made by a join. A half that more words share than fill a shard is cut into a grid:
its words are dealt over several shards, its searches over several more, and each search meets each part of the words.

Nulls: a null text has no words; a null id is spelled as nothing. Ties for a form go to the smallest word in code-point order.
Repeated rows count as often as they stand there. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmix.storage import drop_table, stage

# What a run of letters is, and which letters have a lower-case form.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEFT, RIGHT = 0, 1


@dataclass(frozen=True)
class Settings:
    least_length: int = 7
    least_count: int = 2
    harm: int = 31  # a run whose checksum this number divides loses a letter
    ratio: int = 10  # a form is at least so many times as frequent
    shard_words: int = 60_000
    batch: int = 1024  # searches at a time, and their letters
    batch_letters: int = 1 << 20


def vocabulary(docs: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """``(word, n)`` of the runs of letters, with A-Z lower-cased and some runs damaged by their checksum."""
    runs = docs.select(F.col(key).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("_run"))
    # Damage only shortens, so a run that is too short already needs no checksum.
    low = runs.where(F.length("_run") >= settings.least_length).select("_id", F.translate("_run", UPPER, LOWER).alias("_low"))
    name = F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_low")
    checked = low.select("_low", F.crc32(name.cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_low")).cast("int")
    cut = F.concat(F.substring(F.col("_low"), F.lit(1), at), F.substring(F.col("_low"), at + 2, F.length("_low")))
    words = checked.select(F.when(F.col("_h") % settings.harm == 0, cut).otherwise(F.col("_low")).alias("word"))
    counted = words.where(F.length("word") >= settings.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= settings.least_count)


class FmIndex:
    """Sorted distinct words behind a delimiter each, searched from their ends leftwards.

    ``step`` narrows intervals of suffix ranks by one letter. The letters before all suffixes, in order of rank, are kept as one sorted
    array of (letter, rank): how many entries lie before (c, i) is the new rank, so a step is two binary searches.
    """

    def __init__(self, words: list[str]):
        joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, text = np.unique(joined, return_inverse=True)  # the delimiter is letter 0
        self.size, self.words = len(text), len(words)
        delimiters = np.flatnonzero(text == 0)
        # Each delimiter counts as a letter of its own, in order of place; then doubling tells all suffixes apart.
        rank = text.astype(np.int64) + len(delimiters) - 1
        rank[delimiters] = np.arange(len(delimiters))
        reach = 1
        while True:
            after = np.zeros(self.size, np.int64)
            after[:-reach] = rank[reach:] + 1
            pairs = rank * (self.size + len(delimiters) + 1) + after
            order = np.argsort(pairs, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(pairs[order][1:] != pairs[order][:-1])])
            rank[order] = fresh
            if fresh[-1] == self.size - 1:
                break
            reach *= 2
        self.before = text[order - 1]  # the first suffix is the last delimiter's or comes after it
        self.keys = np.sort(self.before.astype(np.int64) * (self.size + 1) + np.arange(self.size))
        self.text, self.starts = text, delimiters[:-1] + 1

    def patterns(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """One row of letter numbers per text; -1 for a letter that no word has, and behind the end."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, raw)
        at[at == len(self.letters)] = 0
        out = np.full((len(texts), int(lengths.max(initial=1))), -1, np.int64)
        out[np.arange(out.shape[1])[None] < lengths[:, None]] = np.where(self.letters[at] == raw, at, -1)
        return out

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = letter * (self.size + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which letters may come before each interval: pairs of an interval's number and a letter, delimiters left out."""
        wide = high - low >= len(self.letters)
        own = np.flatnonzero(~wide)
        sizes = (high - low)[own]
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        number = np.repeat(own, sizes)
        seen = np.unique(number * len(self.letters) + self.before[low[number] + offset])
        every = (np.flatnonzero(wide)[:, None] * len(self.letters) + np.arange(len(self.letters))[None]).ravel()
        both = np.concatenate([seen, every])
        both = both[both % len(self.letters) > 0]
        return both // len(self.letters), both % len(self.letters)

    def search(self, pattern: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word number)``: words that end with the last ``exact`` letters of a query and have one error before them.

        ``pattern`` holds the queries' letters from their ends: column k is the letter k places before the last.
        """
        rows = np.arange(len(pattern))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.words + 1, np.int64)
        late = [np.zeros(0, np.int64)] * 3  # states that have spent their error: query, low, high
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(int(length.max(initial=0)) + 1):
            # Open states stand before letter k, and so do the late ones.
            spends = (exact[rows] <= k) & (high > low)
            q, a, b = rows[spends], low[spends], high[spends]
            number, letter = self.branches(a, b)
            c, d = self.step(letter, a[number], b[number])
            query, inside = q[number], length[q[number]] > k
            replaced = inside & (letter != pattern[query, np.minimum(k, pattern.shape[1] - 1)])
            dropped = length[q] > k
            # An inserted letter leaves letter k to be matched.
            now = [np.concatenate(x) for x in zip(late, (query, c, d))]
            ends = length[now[0]] == k
            hits.append(self._words(*(x[ends] for x in now)))
            now = [x[~ends] for x in now]
            c2, d2 = self.step(pattern[now[0], k] if len(now[0]) else now[0], now[1], now[2])
            late = [np.concatenate(x) for x in zip((now[0], c2, d2), (query[replaced], c[replaced], d[replaced]), (q[dropped], a[dropped], b[dropped]))]
            alive = late[2] > late[1]
            late = [x[alive] for x in late]
            # The open states match letter k; those at their end are done, as they have no error.
            more = (length[rows] > k) & (high > low)
            rows, low, high = rows[more], low[more], high[more]
            if len(rows):
                letters = pattern[rows, k]
                low, high = self.step(letters, low, high)
                low, high = np.where(letters < 0, 0, low), np.where(letters < 0, 0, high)
        query, word = (np.concatenate(x) for x in zip(*hits))
        pairs = np.unique(query * self.words + word)
        return pairs // self.words, pairs % self.words

    def _words(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word that each interval is, with a delimiter before it; words are distinct, so there is one or none."""
        a, b = self.step(np.zeros(len(low), np.int64), low, high)
        return query[b > a], a[b > a] - 1


def _batches(lengths: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """Searches of like length, so many at a time that their letters stay bounded."""
    order = np.argsort(lengths, kind="stable")
    out, start = [], 0
    while start < len(order):
        end = min(start + settings.batch, len(order))
        while end > start + 1 and (end - start) * int(lengths[order[end - 1]]) > settings.batch_letters:
            end = start + (end - start) // 2
        out.append(order[start:end])
        start = end
    return out


def near_words(words: list[str], counts: np.ndarray, asked: list[str], direction: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each word asked for: how many near words are among ``words`` (sorted) whose half on side ``direction`` is the same,
    and which of these is the most frequent (its place, -1 for none)."""
    turn = (lambda w: w[::-1]) if direction == LEFT else (lambda w: w)
    order = np.array(sorted(range(len(words)), key=lambda i: turn(words[i])))
    index = FmIndex([turn(words[i]) for i in order])
    number, best = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
    lengths = np.array(list(map(len, asked)), np.int64)
    for own in _batches(lengths, settings):
        here, length = [asked[i] for i in own], lengths[own]
        half = length // 2
        # The search runs from the end of a word, or of the reversed one, to its other end.
        pattern = index.patterns([w if direction == LEFT else w[::-1] for w in here], length)
        query, found = index.search(pattern, length, half if direction == LEFT else length - half)
        if direction == RIGHT:
            # Pairs that share the left half too belong to the other direction.
            begins, same = index.starts[found], np.ones(len(query), bool)
            forward = index.patterns(here, length)
            for k in range(int(half.max(initial=0))):
                same &= (half[query] <= k) | (index.text[np.minimum(begins + k, index.size - 1)] == forward[query, k])
            query, found = query[~same], found[~same]
        place = order[found]
        number[own] = np.bincount(query, minlength=len(own))
        ranked = np.lexsort((place, -counts[place], query))
        query, place = query[ranked], place[ranked]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[: len(query)])
        best[own[query[first]]] = place[first]
    return number, best


def _halves(word: Column, direction: int, size: Column) -> Column:
    return F.substring(word, F.lit(1), size) if direction == LEFT else F.substring(word, F.length(word) - size + 1, size)


def near_counts(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(word, n, n_near, best_n, best)`` for a stored table ``(word, n)`` of distinct words; ``best`` is the near word of
    largest n, null where there is none."""
    sent, asking = [], []
    length = F.length("word")
    for direction in (LEFT, RIGHT):
        # The half that a word of this length, or one less or more, keeps.
        own = lambda n: (F.floor(n / 2) if direction == LEFT else F.ceil(n / 2)).cast("int")
        sizes = F.explode(F.array_distinct(F.array(own(length - 1), own(length), own(length + 1))))
        data = words.select("word", "n", sizes.alias("size"))
        sent.append(data.select("word", "n", F.lit(direction).alias("direction"), _halves(F.col("word"), direction, F.col("size")).alias("half")))
        asking.append(words.select("word", "n", F.lit(direction).alias("direction"), _halves(F.col("word"), direction, own(length)).alias("half")))
    data, queries = (a.unionByName(b) for a, b in (sent, asking))
    total = words.count()
    shards = max(1, -(-4 * total // settings.shard_words))
    # A half that fills a shard is cut into a grid; there are no more such halves than shards.
    crowded = data.groupBy("direction", "half").agg(F.count("*").alias("held")).where(F.col("held") > settings.shard_words)
    grid = F.broadcast(crowded.select("direction", "half", F.ceil(F.col("held") / settings.shard_words).cast("int").alias("cuts")))
    key = F.xxhash64("direction", "half", "part", "turn")

    def dealt(rows: DataFrame, mine: str, others: str, asks: bool) -> DataFrame:
        cuts = F.coalesce("cuts", F.lit(1))
        spread = rows.join(grid, ["direction", "half"], "left").withColumn(mine, F.pmod(F.xxhash64("word"), cuts).cast("int"))
        spread = spread.withColumn(others, F.explode(F.sequence(F.lit(0), cuts - 1)))
        # Crowded halves have groups of their own; the others share the numbered ones.
        group = F.when(F.col("cuts").isNull(), F.pmod(key, F.lit(shards))).otherwise(key.bitwiseOR(F.lit(-(2**63))))
        return spread.select("direction", group.alias("shard"), F.lit(asks).alias("asks"), "word", "n")

    rows = dealt(data, "part", "turn", False).unionByName(dealt(queries, "turn", "part", True))
    def run(part: pa.Table) -> pa.Table:
        asks, n = part.column("asks").to_numpy(), part.column("n").to_numpy()
        text = part.column("word").to_numpy()
        words, first = np.unique(text[~asks], return_index=True)
        words, counts, asked = words.tolist(), n[~asks][first], text[asks].tolist()
        # A word that asks has sent itself too, so an index is never empty where there is a search.
        number, best = near_words(words, counts, asked, part.column("direction")[0].as_py(), settings) if asked else (np.zeros(0, int),) * 2
        forms = pa.array([words[b] if b >= 0 else None for b in best.tolist()], pa.string())
        best_n = pa.array(counts[best], pa.int64(), mask=best < 0)
        columns = [pa.array(asked, pa.string()), pa.array(n[asks], pa.int64()), pa.array(number, pa.int64()), best_n, forms]
        return pa.table(columns, ["word", "n", "n_near", "best_n", "best"])

    found = rows.repartition(shards, "direction", "shard").groupBy("direction", "shard").applyInArrow(run, "word string, n long, n_near long, best_n long, best string")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    merged = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return merged.select("word", "n", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of a stored table ``(word, form)``: where its forms lead in the end. Steps double from round to round;
    a form is several times as frequent as its word, so there are few."""
    known = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = stage(known.join(ahead, known["root"] == ahead["_word"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        more = moved.where("moved").limit(1).count()
        drop_table(known)
        known = moved.select("word", "root")
        if not more:
            return known


def variants(docs: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary."""
    words = stage(vocabulary(docs, key, text, settings), "vocabulary")
    near = near_counts(words, settings)
    is_form = F.col("best_n") >= settings.ratio * F.col("n")
    shaped = near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    shaped = stage(shaped, "forms")
    ends = roots(shaped.where("form is not null").select("word", "form"))
    return shaped.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
