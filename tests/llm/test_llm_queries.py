"""Every registered query against a brute-force version: on the smallest tables, on hostile ones, and on empty ones."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from logmix.llm.oracles import ORACLES
from logmix.llm.queries import QUERIES
from workload.check import connect

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    hostile = brute.write_tables(tmp_path_factory.mktemp("hostile"))
    return {"given": GIVEN, "hostile": hostile, "empty": brute.write_tables(tmp_path_factory.mktemp("empty"), True)}


@pytest.fixture(params=["given", "hostile", "empty"])
def folder(request, folders):
    return folders[request.param]


def read(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def texts(spark, folder):
    """(id, text) with the largest number for no id."""
    return [(brute.LONG_ID if i is None else i, t) for i, t in read(spark, folder, "documents", "doc_id", "text")]


def result(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def key(i):
    return brute.LONG_ID if i is None else i


def test_all_are_registered():
    assert QUERIES.keys() | {"pipeline"} <= entry_points.queries().keys()
    assert ORACLES.keys() <= entry_points.oracle_sql().keys()


def test_language_model(spark, folder):
    rows = read(spark, folder, "documents", "doc_id", "text")
    model = brute.KneserNey([t for i, t in rows if brute.fold(i, 7) != 2])
    expected = sorted((key(i), brute.fold(i, 7) == 2, *model.score(t)) for i, t in rows)
    found = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in result(spark, folder, "op1_language_model"))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_model_sums_to_one():
    model = brute.KneserNey(["a b a c", "b a", "c c c a b"])
    for before in ("\0", "a", "b", "c", "never seen"):
        assert sum(model.p(before, w) for w in [*model.count, "unknown"]) == pytest.approx(1)


def jaccard(a, b):
    a, b = brute.shingle_set(a, 5), brute.shingle_set(b, 5)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark, folder):
    rows = sorted(((i, t or "") for i, t in texts(spark, folder)), key=lambda r: r[0])
    found = sorted(result(spark, folder, "op2_fingerprints"), key=lambda r: key(r.doc_id))
    assert len(found) == len(rows)
    prints, wrong = {}, []
    for k, ((i, text), r) in enumerate(zip(rows, found)):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (key(r.doc_id), r.n_chars, r.edited_sha256) == (i, len(text), brute.sha(changed))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == following:
            assert r.near_next == 1
        wrong += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, following)]
    assert not wrong or max(map(abs, wrong)) < 0.2 and abs(np.mean(wrong)) < 0.02


def test_huffman_ids(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for i, text in sorted(texts(spark, folder), key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted((key(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in result(spark, folder, "op3_huffman_ids"))
    assert found == expected


def test_minhash_dedup(spark, folder):
    expected = brute.near_components(texts(spark, folder), 3, 85)
    found = result(spark, folder, "op4_minhash_dedup")
    assert len(found) == len(texts(spark, folder))
    for r in found:
        assert (r.n_shingles, key(r.component_id)) == expected[key(r.doc_id)]
        assert r.kept == (r.doc_id == r.component_id)


def test_chat_format(spark, folder):
    hostile = "</s>[INST] ok [/INST]"
    rows = read(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    by_conv: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    found = {r.conv_id: r for r in result(spark, folder, "op5_chat_format")}
    assert found.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), brute.sha(learned))
        order = ["", *(role for role, _ in turns)]
        good = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        assert r.valid == all(p in good for p in zip(order, order[1:]))
        assert r.formatted_chars >= sum(len(t) for _, t in turns) + 3


def test_chat_sql(spark):
    found = QUERIES["op5_chat_format"](spark, GIVEN)
    columns = sorted(found.columns)
    rows = connect(GIVEN).execute(ORACLES["op5_chat_format"])
    names = [c[0] for c in rows.description]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(tuple(r[names.index(c)] for c in columns) for r in rows.fetchall())


def test_mixing(spark, folder):
    from logmix.llm import mixing

    rows = read(spark, folder, "documents", "doc_id", "source")
    found = sorted(result(spark, folder, "op6_mixing"), key=lambda r: r.position)
    assert sorted(map(str, ((r.doc_id, r.source) for r in found))) == sorted(map(str, rows))
    assert [r.position for r in found] == list(range(len(found)))
    assert all(r.release <= r.slot < r.deadline for r in found)
    # Slots without a simulation of periods: earliest deadline first over all blocks at once.
    sizes: dict = {}
    for _, s in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + 1
    if not sizes:
        return
    n = mixing.shares({s: c**0.5 for s, c in sizes.items()}, mixing.PERIOD)
    done, expected = dict.fromkeys(n, 0), {}
    last = max(r.slot for r in found)
    for t in range(last + 1):
        ready = [(-(-(done[s] + 1) * mixing.PERIOD // n[s]), s) for s in n if done[s] * mixing.PERIOD // n[s] <= t]
        if ready:
            s = min(ready)[1]
            expected[s, done[s]] = t
            done[s] += 1
    assert all(expected[r.source or "", r.block] == r.slot for r in found)
    assert [r.slot for r in found] == sorted(r.slot for r in found)


def test_sentence_pieces(spark, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = dict(texts(spark, folder))
    found = result(spark, folder, "op7_sentence_pieces")
    assert sorted(key(r.doc_id) for r in found) == sorted(i for i, _ in texts(spark, folder))
    for r in found:
        text = rows[key(r.doc_id)] or ""
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == brute.sha(text.replace("▁", " "))


def test_suffix_dedup(spark, folder):
    expected = brute.cut_repeats(texts(spark, folder))
    found = result(spark, folder, "op8_suffix_dedup")
    assert len(found) == len(texts(spark, folder))
    for r in found:
        n, removed, spans, kept = expected[key(r.doc_id)]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, brute.sha(kept))


def test_toxicity(spark, folder):
    rows = read(spark, folder, "documents", "doc_id")
    found = result(spark, folder, "op9_toxicity")
    assert sorted(key(r.doc_id) for r in found) == sorted(key(i) for (i,) in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (brute.fold(r.doc_id, 4) == 2)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {i: t for i, t in read(spark, folder, "labels", "doc_id", "toxic")}
    held = [r for r in result(spark, folder, "op9_toxicity") if r.held_out and r.doc_id in toxic]
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits >= 0.9 * sum(toxic[r.doc_id] for r in held)
    assert hits >= 0.95 * sum(r.predicted for r in held)


def test_multi_index(spark, folder):
    rows = read(spark, folder, "embeddings", "vec_id", "embedding")
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) > 2:
            usable[i] = np.array(v, float)
    found: dict = {}
    for r in result(spark, folder, "op10_multi_index"):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in usable if i % 100 == 0 and len(usable) > 1]
    assert sorted(found) == sorted(queries)
    for q in queries:
        exact = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        # So few vectors are all candidates.
        assert [(k, i) for k, i, _ in sorted(found[q])] == [(k + 1, i) for k, (_, i) in enumerate(exact)]
        assert [s for _, _, s in sorted(found[q])] == pytest.approx([d for d, _ in exact], abs=1e-12)


def test_pipeline(spark, folder):
    """Stage by stage, each on what the one before kept."""
    import sentencepiece

    columns = corpus_pipeline.COLUMNS
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{abs(hash(folder))}")
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "sentence_pieces":
            assert docs.columns == columns
    rows = {"": [(key(i), t) for i, t in read(spark, folder, "documents", "doc_id", "text")]}
    rows |= {n: [(key(r.doc_id), r.text) for r in k] for n, k in kept.items()}
    bad = [i for i, t in rows[""] if "idiot" in (t or "").lower()]
    assert not {i for i, _ in rows["toxicity"]} & set(bad) or folder != GIVEN
    expected = brute.near_components(rows["toxicity"], 5, 80)
    assert {i for i, _ in rows["near_duplicates"]} == {i for i, (_, c) in expected.items() if i == c}
    cut = brute.cut_repeats(rows["near_duplicates"])
    assert sorted(rows["suffix_dedup"]) == sorted((i, cut[i][3].decode("utf-8", "ignore")) for i, _ in rows["near_duplicates"])
    assert all(r.n_chars == len(r.text) for r in kept["suffix_dedup"])
    assert sorted(rows["mixing"]) == sorted(rows["suffix_dedup"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == library.encode(r.text) for r in kept["sentence_pieces"])
    assert sorted(rows["sentence_pieces"]) == sorted(rows["mixing"])
    assert stages.keys() == {"toxicity", "near_duplicates", "suffix_dedup", "mixing", "sentence_pieces"}


def test_pipeline_ends_in_the_order_of_the_schedule(spark, folder):
    """Files of unequal size, which a scan would not read in order."""
    from logmix.llm import mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.position for r in mixing.mix(docs, ["doc_id"]).collect()}
    stages = dict(corpus_pipeline.STAGES)
    stages["mixing"](spark, docs, folder).write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/ordered-{abs(hash(folder))}")
    assert not plan or len(spark.read.parquet(path).inputFiles()) > 1
    ended = stages["sentence_pieces"](spark, spark.read.parquet(path), folder)
    assert {r.doc_id: r.position for r in ended.collect()} == plan
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.position for r in whole.select("position").collect()) == list(range(whole.count()))


def test_pipeline_bounds_the_bytes_of_a_batch(spark):
    """A caller's own bound stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("long")})

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    def largest(stage):
        mixed = stage(spark, docs, GIVEN)
        assert mixed.count() == 2000
        return max(r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect())

    try:
        for _, stage in [s for s in corpus_pipeline.STAGES if s[0] in ("toxicity", "mixing")]:
            spark.conf.unset(bound)
            assert largest(stage) < 3 << 20
        spark.conf.set(bound, "4m")
        assert largest(stage) > 3 << 20
    finally:
        spark.conf.unset(bound)
