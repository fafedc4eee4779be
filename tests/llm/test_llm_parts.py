"""The parts that operators are made of."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logmix.llm import batches as bt
from logmix.llm import chat_format, fingerprints, huffman_ids, minhash_dedup, mixing, sentence_pieces, toxicity
from logmix.llm.components import components
from logmix.llm.shipping import ship
from logmix.llm.store import build, build_blobs


@pytest.fixture(autouse=True)
def package(spark):
    ship(spark)


def test_scrambling_and_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 999, dtype=np.uint64))
    assert (bt.unmix(bt.mix(keys)) == keys).all()
    k, v = bt.unpack(bt.pack(keys, np.arange(len(keys))), 2)
    assert (k == keys).all() and (v == np.arange(len(keys))).all()
    assert bt.shard_bounds(keys, 7)[-1] == len(keys) and not len(bt.unpack(bt.pack(keys[:0], keys[:0]), 2)[0])


def test_words_and_shingles_stay_in_their_text():
    texts = ["a b c d", None, "", " c\td\n", "A B", "a", "b a b c d"]
    data, offsets = bt.raw_texts(pa.array(texts))
    hashes, counts = bt.words(data, offsets)
    assert counts.tolist() == [4, 0, 0, 2, 2, 1, 5]
    found, number = bt.shingles(hashes, counts, 3)
    assert number.tolist() == [2, 0, 0, 1, 1, 1, 3]
    assert found[0] == found[6] and found[1] == found[7] and len(set(found.tolist())) == 6
    assert [b - a for a, b in bt.slices(offsets, 4)] and sum(b - a for a, b in bt.slices(offsets, 4)) == len(texts)


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(int(a) + 200, int(b) + 200) for a, b in draw.integers(0, 200, (120, 2))] + [(5, 5), (0, 1), (1, 0)]
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if i not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stores(spark):
    rows = spark.range(-50, 50).select("id", (F.col("id") * 3).alias("v"), F.encode(F.col("id").cast("string"), "UTF-8").alias("b"))
    numbers = build(rows.unionByName(rows), "id", ["v"], "t")
    wanted = np.sort(bt.mix(np.arange(-60, 60).view(np.uint64)))
    ids = bt.unmix(wanted).view(np.int64)
    (v,) = numbers.lookup(wanted, [-1])
    assert (v == np.where((ids >= -50) & (ids < 50), ids * 3, -1)).all()
    blobs = build_blobs(rows, "id", "b", "t")
    assert blobs.get(np.array([7, -3, 999, 7])) == [b"7", b"-3", None, b"7"]
    assert build_blobs(rows.where("false"), "id", "b", "t").get(np.array([1])) == [None]


def test_code_lengths():
    draw = np.random.default_rng(0)
    for counts in (draw.integers(1, 9, 300), np.array([2**k for k in range(30)]), np.array([5]), np.array([1, 1])):
        lengths = huffman_ids.code_lengths(counts, 20)
        assert lengths.max() <= 20 and sum(2.0 ** -int(x) for x in lengths) <= 1
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        if len(counts) > 1 and len(counts) != 30:
            assert (counts * lengths).sum() == cost
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(5), 2)


def test_codes_round_trip():
    draw = np.random.default_rng(4)
    ids = np.minimum(draw.zipf(1.3, 5000), 900).astype(np.int64)
    used, counts = np.unique(ids, return_counts=True)
    code = huffman_ids.Code(used, huffman_ids.code_lengths(counts))
    sizes = np.array([1, 4000, 511, 488])
    data, begins, at = huffman_ids.encode_rows(ids, sizes, *code.by_id())
    first = np.cumsum(sizes) - sizes
    got = huffman_ids.decode_lanes(np.frombuffer(data, np.uint8), begins * 8, sizes, code.table(), code.longest)
    assert (got == ids).all() and (at[first] == begins * 8).all()


def test_viterbi_equals_the_library(spark, tmp_path):
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = file.read()
    spec = dict(sentence_pieces._fields(raw))[2]
    at = raw.index(spec) + spec.index(b"\x18\x02")
    (tmp_path / "unigram.model").write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    model = str(tmp_path / "unigram.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["The quick brown fox", "Donaudampfschiff, naïve!", "a  b\n\nc", "über 12345 x̱", "", None, "antidisestablishmentarianism " * 3, "z" * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert sentence_pieces.load(model).kind == sentence_pieces.UNIGRAM
    for r in sentence_pieces.encode(rows, "text", ["id"], model).collect():
        assert r["ids"] == library.encode(texts[r["id"]] or "")


def test_pruning_never_drops_an_equal_pair():
    settings = minhash_dedup.Settings()
    least = settings.least_matches()
    sign = np.arange(settings.positions, dtype=np.uint32)
    far = sign + 1
    close = np.where(sign % 6 == 0, 9999, sign).astype(np.uint32)
    assert minhash_dedup._survivors(sign, np.stack([sign, far, close]), least).tolist() == [0, 2]
    assert [n for n, _ in least][-1] == settings.positions and all(m <= n for n, m in least)


@pytest.mark.parametrize("percent", [10, 50, 80, 85, 95, 100])
def test_bands_fit_the_threshold(percent):
    settings = minhash_dedup.Settings(percent=percent)
    assert (1 - (percent / 100) ** settings.rows) ** settings.bands <= settings.miss
    assert settings.bands * settings.rows == settings.positions and settings.positions % settings.batch == 0
    assert percent != 85 or (settings.bands, settings.rows) == (24, 5)


def test_large_groups_are_split(spark, monkeypatch):
    """A ring of near copies: most are not linked with the pivot, and blocks of two hold them."""
    monkeypatch.setattr(minhash_dedup, "_BLOCK", 2)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[k * 6 : k * 6 + 120]) for k in range(12)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    settings = minhash_dedup.Settings(shingle=3, percent=85)
    found = {r["id"]: r["component_id"] for r in minhash_dedup.near_duplicates(rows, "id", "text", settings).collect()}
    assert found == dict.fromkeys(range(12), 0)


def test_shares_and_deviation():
    plan = mixing.schedule({"a": 5, "b": 3, "c": 1, "d": 0.001}, 500)
    assert sum(plan.slots) == 500 and min(plan.slots) == 1
    for i, n in enumerate(plan.slots):
        assert (np.abs(plan.before[:, i] - np.arange(500) * n / 500) < 1).all()
        block = np.arange(3 * n)
        release, deadline = plan.window(i, block)
        assert ((release <= plan.slot(i, block)) & (plan.slot(i, block) < deadline)).all()
    with pytest.raises(ValueError):
        mixing.schedule({"a": 0.0}, 10)


def test_deviation_from_the_weights_over_a_large_table():
    """Twenty sources, one with a third of 600,000 rows, and the share of one in a million."""
    sizes = {f"s{i:02}": 200_000 if i == 0 else 21_053 for i in range(20)}
    roots = {s: n**0.5 for s, n in sizes.items()}
    for weights in (roots, {**roots, "s19": sum(roots.values()) * 1e-6}):
        blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()} | ({} if weights is roots else {"s19": 1})
        plan = mixing.schedule(weights, blocks=blocks)
        before = plan.before[: min(int(p[-1]) for p in plan.place if len(p) > 1)]
        for i, s in enumerate(plan.sources):
            target = np.arange(len(before)) * weights[s] / sum(weights.values())
            assert np.abs(before[:, i] - target).max() < (1 + 1e-4)
            assert len(plan.place[i]) == blocks[s] and (np.diff(plan.place[i]) > 0).all()


def test_small_weights_do_not_lengthen_the_layout(monkeypatch):
    monkeypatch.setattr(mixing, "_SKIPPED", 5000)
    plan = mixing.schedule({"a": 1, "b": 1e-9, "c": 2e-9}, blocks={"a": 900, "b": 50, "c": 70})
    for i, n in enumerate((900, 50, 70)):
        release, deadline = plan.window(i, np.arange(n))
        assert len(plan.place[i]) == n and ((release <= plan.place[i]) & (plan.place[i] < deadline)).all()
    assert len(set(np.concatenate(plan.place).tolist())) == 1020


def test_a_text_in_many_copies_hides_no_other_stem(spark):
    """Its rarer words begin in more ways than are weighed in a round."""
    draw = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in draw.integers(0, 26, 9))
    plain = [word() for _ in range(40)]
    long = " ".join(word() for _ in range(600))
    texts = [(long, 1)] * 60 + [(f"{plain[i % 40]} {plain[i * 7 % 40]} blorp{word()}", 1) for i in range(12)]
    texts += [(f"{plain[i % 40]} {plain[i * 3 % 40]}", 0) for i in range(300)]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "_key long, _text string, _toxic int")
    stems = toxicity.learn_stems(rows, toxicity.Settings())
    assert any("blorp".startswith(s) or s.startswith("blorp") for s in stems)
    assert any(w.startswith(s) for s in stems for w in long.split())
    # A portion of one candidate a round ends with every toxic text explained, too.
    one = toxicity.base_grammar(toxicity.learn_stems(rows, toxicity.Settings(candidates=1)))
    assert all(any(toxicity.readings(one, t)) == bool(y) for t, y in texts)


def test_readings():
    grammar = toxicity.base_grammar({"blorp": 2})
    of = lambda text: {f for f, n in zip(toxicity.FEATURES, toxicity.readings(grammar, text.lower())) if n}
    assert of("Nothing to see.") == set()
    assert of("You are an idiot. Trash!") == {"insult_aimed", "insult_plain"}
    assert of("This is not really trash") == {"insult_negated"}
    assert of('She said: nothing. He said "idiot"') == {"insult_reported"}
    assert of("I will kill you") == {"threat_aimed"}
    assert of("blorpish words") == {"hint"} and of("blorpish, blorpen") == {"insult_plain"}


def test_roles_cannot_end_early():
    template = chat_format.Template()
    for role in ("<<ROLE a>> ", "x>>>y", "\\>", "", ">", "a\\.b"):
        _, made = chat_format.write_turn(template, "", role, "t>> <</ROLE>>\\", True)
        assert chat_format.read_turn(template, "".join(t for t, _ in made), True) == (role, "t>> <</ROLE>>\\")
    with pytest.raises(ValueError):
        chat_format.read_turn(template, "no opening", True)


def test_fingerprints_run_without_python(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    plan = fingerprints.edited_fingerprints(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
