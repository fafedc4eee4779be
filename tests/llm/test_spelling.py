"""Spelling variants against brute force: the index on random words, the query on hostile tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from logmix.llm import spelling
from logmix.llm.queries import QUERIES

NAME = "op11_spelling_variants"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def expected(counts):
    forms, out = {}, []
    for w, n in counts.items():
        own = sorted((-m, x) for x, m in counts.items() if near(w, x))
        form = own[0][1] if own and -own[0][0] >= 10 * n else None
        forms[w] = form
        out.append([w, form, None, n, len(own), counts[form] if form else None])
    for row in out:
        row[2] = row[0]
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out))


def found(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def some_words(draw, number):
    """Words of few letters, many of them near each other, with common beginnings and ends."""
    made = set()
    while len(made) < number:
        w = draw.choice(["aaa", "", "ab"]) + "".join(draw.choice("abé") for _ in range(draw.randrange(7, 11))) + draw.choice(["", "bbbb"])
        made.add(w)
        if draw.random() < 0.5:
            at = draw.randrange(len(w))
            other = w[:at] + draw.choice(["", "a", "é" + w[at], "z"]) + w[at + 1 :]
            if len(other) >= 7:
                made.add(other)
    return sorted(made)


@pytest.mark.parametrize("direction", [spelling.LEFT, spelling.RIGHT])
@pytest.mark.parametrize("batch", [3, 1024])
def test_searches(direction, batch):
    """Each direction finds the near words that share its half; together they find each just once."""
    draw = random.Random(1)
    words = some_words(draw, 250)
    counts = np.array([draw.randrange(2, 9) for _ in words])
    asked = [*words, "unknowable", "aaaaaaa"]
    number, best = spelling.near_words(words, counts, asked, direction, spelling.Settings(batch=batch))
    for w, n, b in zip(asked, number, best):
        half = len(w) // 2
        own = [k for k, x in enumerate(words) if near(w, x) and (x.startswith(w[:half]) if direction == spelling.LEFT else not x.startswith(w[:half]))]
        assert n == len(own)
        assert b == min(own, key=lambda k: (-counts[k], words[k]), default=-1)


def test_index_ranks():
    words = ["abc", "abcd", "b", "é" * 300]
    index = spelling.FmIndex(words)
    delimited = "\0" + "\0".join(words) + "\0"
    assert index.size == len(delimited) and index.words == 4
    pattern = index.patterns(["dbc", "é" * 299], np.array([3, 299]))
    assert index.patterns(["c?"], np.array([2])).tolist()[0][1] == -1
    assert pattern.shape == (2, 299)


@pytest.mark.parametrize("shard_words", [20, 60_000])
def test_crowded_halves(spark, shard_words):
    """Halves that fill a shard many times over, and very long words."""
    draw = random.Random(2)
    counts = {w: draw.randrange(2, 400) for w in [*some_words(draw, 300), "x" * 5000, "x" * 4999 + "y"]}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.near_counts(words, spelling.Settings(shard_words=shard_words)).collect()
    assert len(got) == len(counts)
    for r in got:
        own = sorted((-m, x) for x, m in counts.items() if near(r.word, x))
        assert (r.n, r.n_near) == (counts[r.word], len(own))
        assert (r.best, r.best_n) == ((own[0][1], -own[0][0]) if own else (None, None))


def test_roots_follow_all_steps(spark):
    steps = [(chr(97 + i) * 7, chr(98 + i) * 7) for i in range(11)]
    frame = spark.createDataFrame(steps, "word string, form string")
    assert sorted(map(tuple, spelling.roots(frame).collect())) == sorted((a, "l" * 7) for a, _ in steps)


@pytest.mark.parametrize("kind", ["hostile", "given", "empty"])
def test_query(spark, tmp_path, kind):
    folder = "/root/testdata/sf0.001" if kind == "given" else brute.write_tables(tmp_path, kind == "empty")
    if kind == "hostile":
        extra = [
            (900 + i, ("Ärgerlich " * 30 + "ärgerlich argerlich ") * (1 + i % 3) + "Étrange÷ment " * 11 + "Étrangement", "de", "a")
            for i in range(40)
        ]
        brute._write(tmp_path, "documents", brute.documents([*brute.DOCUMENTS, *extra]))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(vocabulary(rows))
    assert found(QUERIES[NAME](spark, folder)) == want
    assert bool(want) == (kind != "empty")
