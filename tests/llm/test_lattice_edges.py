"""op7: pieces are found by one number, and pieces of one character are looked up after the merges."""

from __future__ import annotations

import public_tokenizers

from logmix.llm import sentence_pieces as sp

WORDS = ["▁some", "▁zq\U0001f600x", "▁é日本▁", "a\U00020000b", "x\U0010ffffy", "▁asqueuear.", "a", "日"]


def _lattice(spark, pieces):
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(WORDS)], "word string, key long").repartition(2)
    return sp.lattice(rows, pieces)


def test_the_join_has_one_number_as_key(spark):
    pieces = sp.load(public_tokenizers.path("piece_bpe_32k.model"))
    plan = _lattice(spark, pieces)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    left, right = join.split("BroadcastHashJoin ")[1].split("], [")
    assert "," not in left and "," not in right.split("]")[0]


def test_single_characters_are_no_edges_and_keep_their_ids(spark):
    pieces = sp.load(public_tokenizers.path("piece_bpe_32k.model"))
    edges = _lattice(spark, pieces)
    assert all((e >> sp._END_AT & 255) - (e >> sp._START_AT & 255) > 1 for r in edges.collect() for e in r["edges"])
    ids = {r["key"]: r["ids"] for r in sp.fold(edges, pieces).collect()}
    assert {0, 1, 2, 5} <= ids.keys() and all(found == sp.fold_long(WORDS[k], pieces) for k, found in ids.items())


def test_single_characters_of_other_models(spark):
    rows = spark.createDataFrame([("ab\U00020000cab", 0), ("cab", 1)], "word string, key long")
    for singles in ({}, {"c": -9.0}, {"c": -9.0, "\U00020000": -9.5}):
        for byte_ids in (list(range(3, 259)), []):
            scores = {"ab": -1.0} | singles
            pieces = sp.Pieces(sp.BPE, {p: 300 + k for k, p in enumerate(scores)}, scores, byte_ids, 0, [b""] * 400)
            got = {r["key"]: r["ids"] for r in sp.fold(sp.lattice(rows, pieces), pieces).collect()}
            assert got == {k: sp.fold_long(w, pieces) for k, w in enumerate(["ab\U00020000cab", "cab"])}
