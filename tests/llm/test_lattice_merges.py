"""op7: one Python process for each task, and merges in one pass over the edges with the ids of a loop over all of them."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers

from logmix.llm import sentence_pieces as sp
from logmix.llm.queries import QUERIES
from logmix.llm.shipping import ship


def test_encoding_and_decoding_share_a_process(spark):
    plan = QUERIES["op7_sentence_pieces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_round_trip_equals_the_two_steps(spark):
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "\n", "some words\n\n  and", "▁ sign", "日本語 x", "no" * 60, "a\x00b \U0001f600"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    apart = sp.decode(sp.encode(rows, "text", ["id"], model), "ids", ["id", "ids"], model)
    both = sp.encode_and_decode(rows, "text", ["id"], model)
    assert both.columns == ["id", "ids", "decoded"]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    assert both.select("id").count() == len(texts)


def _pieces(scores: dict[str, float]) -> sp.Pieces:
    ids = {p: 300 + k for k, p in enumerate(scores)}
    return sp.Pieces(sp.BPE, ids, scores, list(range(3, 259)), 0, [b""] * (300 + len(ids)))


def test_pieces_that_become_whole_late(spark):
    # "abc" has the best score, but only "bc", which comes after it by rank, leads there.
    late = _pieces({"a": -9.0, "b": -9.0, "c": -9.0, "abc": -1.0, "bc": -2.0})
    assert sp._late(late) == {"bc"}
    draw = random.Random(5)
    models = [late]
    for _ in range(4):
        found = ["".join(x) for n in (2, 3, 4) for x in itertools.product("abc", repeat=n)]
        scores = {p: -float(draw.randrange(12)) for p in draw.sample(found, 30)}
        models.append(_pieces(scores | {"a": -50.0, "b": -50.0}))
    words = ["abc", "c", "cabcab"] + ["".join(draw.choices("abc", k=draw.randrange(1, 15))) for _ in range(150)]
    words = sorted(set(words))
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, key long").repartition(2)
    restarted = 0
    for pieces in models:
        got = {r["key"]: r["ids"] for r in sp.fold(sp.lattice(rows, pieces), pieces).collect()}
        assert got and all(ids == sp.fold_long(words[k], pieces) for k, ids in got.items())
        restarted += bool(sp._late(pieces))
    assert restarted > 1


def test_words_already_sent_are_found_by_search():
    sent = np.array([3, 5, 9], np.uint64)
    keys = np.array([1, 5, 10], np.uint64)
    assert sp.find(sent, keys).tolist() == [-1, 1, -1] and sp.find(sent[:0], keys).tolist() == [-1] * 3
