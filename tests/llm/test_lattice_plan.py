"""The lattice of op7 moves words once: its groups use the partitioning of the distinct words."""

from __future__ import annotations

import public_tokenizers

from logmix.llm import sentence_pieces as sp


def test_edges_are_not_shuffled(spark):
    pieces = sp.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = spark.createDataFrame([("some words and some more",)], "_text string")
    plan = sp.fold(sp.lattice(sp._words_of(texts), pieces), pieces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION") <= 2 and plan.count("Exchange hashpartitioning") == 1
