"""Plain single-process versions of what the operators compute, and hostile tables to run them on."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

LONG_ID = 2**63 - 1


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text: str | None, size: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_components(rows: list[tuple], size: int, percent: int) -> dict:
    """(id, text) rows to the least id of each row's component; ids are unique but for repeated rows."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def cut_repeats(rows: list[tuple], length: int = 50) -> dict:
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, kept)
    return out


class KneserNey:
    """The bigram model by its definition, on words as strings."""

    def __init__(self, texts: list[str | None]):
        lines = [[*words(t), "\n"] for t in texts]
        self.count = Counter(w for line in lines for w in line)
        self.n, self.v, self.texts = sum(self.count.values()), len(self.count), len(texts)
        self.pairs = Counter(p for line in lines for p in zip(["\0", *line], line))
        self.followers = defaultdict(list)
        before = Counter()
        for (a, b), c in self.pairs.items():
            self.followers[a].append(c)
            before[b] += 1
        self.before = before
        self.d = self.discounts(self.pairs.values())
        self.e = self.discounts(before.values())

    @staticmethod
    def discounts(counts) -> list[float]:
        n = Counter(counts)
        if min(n[k] for k in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3))]

    def p(self, a: str, b: str) -> float:
        rest = 1 / (self.v + 1)
        if self.before:
            total = sum(self.before.values())
            back = sum(self.e[min(k, 3)] for k in self.before.values()) / total
            low = max(self.before[b] - self.e[min(self.before[b], 3)], 0) / total + back * rest
        else:
            low = rest
        total = self.texts if a == "\0" else self.count[a] if a != "\n" else 0
        if not total:
            return low
        c = self.pairs[a, b]
        back = sum(self.d[min(k, 3)] for k in self.followers[a]) / total
        return max(c - self.d[min(c, 3)], 0) / total + back * low

    def score(self, text: str | None) -> tuple:
        line = [*words(text), "\n"]
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in line)
        own = sum(math.log10(self.p(a, b)) for a, b in zip(["\0", *line], line))
        return len(line), sum(self.count[w] > 0 for w in line), self.n, base, own


def fold(key, folds: int) -> int:
    return 0 if key is None else zlib.crc32(str(key).encode()) % folds


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards boil the kettle twice. "
STORY = " ".join(f"w{i} and x{i * 7 % 91}" for i in range(120))
#: (doc_id, text, lang, source): nulls, empties, copies, near copies, blanks of all kinds, a long word, a long text.
DOCUMENTS = [
    (0, STORY, "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "b"),
    (4, STORY, "en", "a"),
    (5, STORY.replace("w60 ", "changed "), "en", "c"),
    (6, PASSAGE + "é" * 60 + " only here", "fr", "a"),
    (7, "before " + PASSAGE * 2 + "after", "en", "a"),
    (8, "é" * 45 + "ü" + PASSAGE[:55], "de", "a"),
    (9, "x" * 5000, "en", "a"),
    (10, "of " * 400, "en", "a"),
    (11, "of " * 300 + "end", "en", "a"),
    (12, "Two words", "en", "b"),
    (13, "two WORDS", "en", "b"),
    (14, "a b▁c <|endoftext|> \\ [INST] 'S don't \x0b\x0c é \U0001f600", "en", "b"),
    (15, " ".join(f"long{i % 7001}" for i in range(60_000)), "en", "a"),
    (4, STORY, "en", "a"),
    (-3, STORY[:200] + " idiot! " + STORY[200:], "en", ""),
    (None, PASSAGE + "without an id", None, "a"),
]
CLASHING = ("_text", "_id", "_key", "ids", "n", "kept", "position", "score", "node", "shard")


def _write(folder, name: str, table: pa.Table) -> None:
    pq.write_table(table, f"{folder}/{name}.parquet")


def documents(rows) -> pa.Table:
    columns = dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows)) if rows else ([], [], [], [])))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    made = {c: pa.array(columns[c], kinds[c]) for c in kinds}
    made["n_chars"] = pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())
    made |= {c: pa.array(["clash"] * len(rows), pa.string()) for c in CLASHING}
    return pa.table(made)


CONVERSATIONS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "</s> [INST] <<SYS>> \\. \\\\ <s>"), (1, 1, "assistant", "tie"),
    (2, 0, "assistant", "first"), (2, 1, "narrator", "who?"), (2, 2, None, None), (2, None, "user", ""),
    (3, 0, "system", "be kind\n"), (3, 1, "user", "<<ROLE x>> é"), (3, 2, "assistant", "y" * 100_000),
    (3, 2, "assistant", "y" * 100_000), (None, 0, "user", "no id"), (4, 0, "<<ROLE a>> ", "odd role"),
]


def conversations(rows) -> pa.Table:
    cut = list(map(list, zip(*rows))) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    made = {n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), cut, kinds)}
    return pa.table(made | {c: pa.array([0] * len(rows)) for c in ("position", "valid", "segments")})


def embeddings(rows) -> pa.Table:
    return pa.table(
        {
            "vec_id": pa.array([r[0] for r in rows], pa.int64()),
            "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
            "cell": pa.array([None] * len(rows), pa.string()),
            "reach": pa.array(["clash"] * len(rows), pa.string()),
        }
    )


NAN, INF = float("nan"), float("inf")
EMBEDDINGS = [
    *[(i, [math.sin(i * 7.1 + k * k) + (i % 3) for k in range(6)]) for i in range(-20, 60)],
    *[(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(100, 130)],
    (200, None), (300, [0.0] * 6), (400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (500, [NAN] + [1.0] * 5),
    (600, [INF] + [1.0] * 5), (700, [1.0, 2.0]), (None, [1.0] * 6), (100, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (800, []),
]


def write_tables(folder, empty: bool = False) -> str:
    rows = lambda x: [] if empty else x
    _write(folder, "documents", documents(rows(DOCUMENTS)))
    _write(folder, "conversations", conversations(rows(CONVERSATIONS)))
    _write(folder, "embeddings", embeddings(rows(EMBEDDINGS)))
    labels = rows([(0, 1, 0), (4, 1, None), (-3, None, 1), (None, 0, 1), (99, 0, 1), (6, 1, 0), (6, 1, 0)])
    cut = list(map(list, zip(*labels))) or [[], [], []]
    _write(folder, "labels", pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "quality", "toxic"), cut)}))
    return str(folder)
