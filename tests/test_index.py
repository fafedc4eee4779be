from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from logmix.operators import cells
from logmix.operators.lookup import Keyed, lookup, split_budget
from logmix.operators.ranking import rank_ordered
from logmix.plans.counting import line_index
from logmix.plans.indexing import encode, index_features
from logmix.sources import sinks, text
from logmix.storage import stage

SPEC = "color 0 look\nscore 1 look\nsize\t0\tlook\nconst 0 other\n"
RAW = "red\t0.1\tS\tz\nblue\t0.2\tL\tz\n\t0.3\tS\tz\nred\t0.4\t\tz\n"
NAMES = ["color", "score", "size", "const"]


@pytest.fixture()
def spec(spark, tmp_path):
    (tmp_path / "spec.txt").write_text(SPEC)
    return text.read_spec(spark, str(tmp_path / "spec.txt"))


@pytest.fixture()
def raw(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "part-0.tsv").write_text(RAW)
    return text.read_tsv(spark, str(tmp_path / "raw" / "*.tsv"), NAMES)


def test_read_spec(spec):
    assert rows(spec, "pos") == [
        (0, "color", 0, "look"), (1, "score", 1, "look"), (2, "size", 0, "look"), (3, "const", 0, "other"),
    ]
    assert [r[0] for r in rows(text.raw_fields(spec), "pos")] == [0, 2, 3]


def test_read_tsv_never_shifts(spark, tmp_path):
    (tmp_path / "odd.tsv").write_text('a\n\tb\tc\n"q\tx"\ty\tz\textra\n\n')
    got = rows(text.read_tsv(spark, str(tmp_path / "odd.tsv"), ["c0", "c1", "c2"]))
    assert got == [("a", None, None), (None, "b", "c"), ('"q', 'x"', "y"), (None, None, None)]


@pytest.mark.parametrize(
    "options, names",
    [
        ({"min_cutoff": 1}, ["color", "size", "const"]),
        ({"min_cutoff": 2}, ["color", "size"]),
        ({"min_cutoff": 1, "min_exclusive": True}, ["color", "size"]),
        ({"min_cutoff": 2, "min_exclusive": True}, []),
        ({"min_cutoff": 1, "max_cutoff": 1}, ["const"]),
    ],
)
def test_cutoffs(raw, spec, options, names):
    index = index_features(raw, spec, **options)
    assert [(r["feature_id"], r["name"]) for r in index.kept.orderBy("pos").collect()] == list(enumerate(names))
    assert index.columns == [f"f{i}" for i in range(len(names))]


@pytest.mark.parametrize("max_cutoff", [None, 1000])
@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_index(raw, spec, max_cutoff, budget):
    index = index_features(raw, spec, 2, max_cutoff, budget=budget)
    assert rows(index.dictionary, "feature_id", "value_id") == [
        (0, "blue", 0, 1), (0, "red", 1, 2), (1, "L", 0, 1), (1, "S", 1, 2),
    ]
    assert sorted(rows(index.encoded), key=str) == sorted([(1, 1), (0, 0), (None, 1), (1, None)], key=str)


def test_values_are_ordered_as_strings(spark, spec):
    raw = spark.createDataFrame([(v, "", v, "z") for v in ["9", "10", "a", "B", "é"]], "a string, b string, c string, d string")
    index = index_features(raw, spec, 2)
    assert [r["value"] for r in index.dictionary.where("feature_id = 0").orderBy("value_id").collect()] == ["10", "9", "B", "a", "é"]


def test_empty_column_is_reported(spark, spec):
    raw = spark.createDataFrame([("a", "1", "", "z"), ("b", "2", "", "z")], "a string, b string, c string, d string")
    counts = cells.value_counts(raw, ["a", "c", "d"], [0, 2, 3])
    assert [r["name"] for r in cells.empty_features(text.raw_fields(spec), cells.cardinality(counts)).collect()] == ["size"]


def hot_rows(spark, n=20_000):
    """A third of the rows hold one value, a sixth are missing, the rest are all different."""
    value = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("v"), F.col("id"))
    )
    return spark.range(n).select("id", value.alias("value"))


@pytest.mark.parametrize("rank", [rank_ordered])
def test_ranks(spark, rank):
    data = spark.range(5000).select((F.col("id") % 2).alias("g"), F.hash("id").cast("string").alias("v"))
    got = rows(rank(data, ["g"], ["v"], "r").select("g", "v", "r"), "g", "r")
    for g in (0, 1):
        values = [v for x, v, _ in got if x == g]
        assert values == sorted(values) and [r for x, _, r in got if x == g] == list(range(len(values)))


def test_rank_splits_one_giant_group(spark):
    ranked = rank_ordered(hot_rows(spark).where("value is not null"), [], ["value", "id"], "r")
    got = ranked.select("value", "id", "r").collect()
    assert sorted(x["r"] for x in got) == list(range(len(got)))
    assert [x["r"] for x in sorted(got, key=lambda x: (x["value"], x["id"]))] == list(range(len(got)))


def test_ranking_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    lines = spark.range(3000).select("id", F.hash("id").cast("string").alias("value")).mapInPandas(count, "id long, value string")
    assert line_index(lines, "id").count() == 3000
    assert seen.value == 3000


def test_line_index_numbers_copies(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["b", "a", "b", "", "b"])], "id int, value string")
    assert rows(line_index(lines, "id").select("line_id", "value"), "line_id") == [
        (1, ""), (2, "a"), (3, "b"), (4, "b"), (5, "b"),
    ]


def test_split_lookup_equals_broadcast(spark):
    data = hot_rows(spark).withColumn("row", F.monotonically_increasing_id())
    counts = data.where("value is not null and value <> 'v5'").groupBy("value").agg(F.count("*").alias("cnt"))
    table = counts.withColumn("code", F.xxhash64("value"))
    keyed = Keyed(table, "value", "code", 16_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        split = lookup(data, "value", keyed, "c", False, F.col("row")).select("id", "value", "c")
        plain = lookup(data, "value", keyed, "c", True).select("id", "value", "c")
        assert rows(split, "id") == rows(plain, "id")
        assert split.where("c is null and value is not null").select("value").distinct().collect()[0][0] == "v5"
        assert "SortMergeJoin [_seek" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_lookup_spreads_hot_and_missing_rows(spark):
    data = hot_rows(spark).withColumn("row", F.monotonically_increasing_id())
    table = data.where("value is not null").groupBy("value").agg(F.count("*").alias("cnt")).withColumn("code", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(data, "value", Keyed(table, "value", "code", 16_000), "c", False, F.col("row"))
        assert re.search(r"hashpartitioning\(_seek#\d+, _slot#\d+L, 8\)", joined._jdf.queryExecution().toString())
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_split_budget():
    assert split_budget({0: 5, 1: 1, 2: 3}, 4) == {1, 2}
    assert split_budget({0: 5}, 4) == set()


def test_out_of_domain(spark):
    found = spark.createDataFrame([(0, 1), (0, 7), (0, 7), (1, 0)], "feature_id int, value_id int")
    domain = spark.createDataFrame([(0, 1), (1, 0)], "feature_id int, value_id int")
    assert rows(cells.out_of_domain_cells(found, domain)) == [(0, 7, 2)]


def test_unknown_values_are_missing(spark):
    dictionary = spark.createDataFrame([(0, "a", 0, 2)], "feature_id int, value string, value_id bigint, cnt bigint")
    data = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "x string")
    assert rows(encode(data, ["x"], dictionary)) == [(0,), (None,), (None,), (None,)]


def test_large_dictionaries_share_one_shuffle(spark):
    """Three large columns cost as many exchanges as one, a hot pair and missing cells included, and give the same ids."""
    data = hot_rows(spark).select("id", "value", F.concat(F.lit("w"), (F.col("id") % 9).cast("string")).alias("b"), F.nullif("value", F.lit("v7")).alias("c"))
    data = stage(data.withColumn("row", F.monotonically_increasing_id()), "large")
    counts = cells.value_counts(data, ["value", "b", "c"], [0, 1, 2])
    dictionary = stage(rank_ordered(counts, ["feature_id"], ["value"], "value_id"), "dictionary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        exchanges = []
        for columns in (["value"], ["value", "b", "c"]):
            coded = encode(data, columns, dictionary.where(F.col("feature_id") < len(columns)), "id", budget=0, row_id="row")
            plan = coded._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("Join") == 3  # hot pairs, other pairs, back to the rows
            exchanges.append(coded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        assert exchanges[0] == exchanges[1] <= 4
        assert rows(coded, "id") == rows(encode(data, columns, dictionary, "id"), "id")
        part = encode(data, columns, dictionary, "id", budget=1000, row_id="row")
        assert rows(part, "id") == rows(coded, "id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_round_trip(spark, raw, spec, tmp_path):
    index = index_features(raw, spec, 2)
    for _ in range(2):  # the second write replaces the first
        sinks.write_vectors(index.encoded, index.columns, f"{tmp_path}/data")
        sinks.write_table(index.dictionary, f"{tmp_path}/dictionary", ["feature_id"])
        sinks.write_dictionary_text(index.dictionary, f"{tmp_path}/feature")
        sinks.write_kept(index.kept, f"{tmp_path}/kept")
    lines = [r["value"] for r in text.read_lines(spark, f"{tmp_path}/data", 2).collect()]
    assert sorted(lines) == ["-1 1", "0 0", "1 -1", "1 1"]
    again = text.parse_vectors(text.read_lines(spark, f"{tmp_path}/data"), 2)
    assert again.schema.simpleString() == "struct<f0:int,f1:int>"
    assert sorted(rows(again), key=str) == sorted(rows(index.encoded), key=str)
    stored = spark.read.parquet(f"{tmp_path}/dictionary").select(*index.dictionary.columns)
    assert rows(stored, "feature_id", "value_id") == rows(index.dictionary, "feature_id", "value_id")
    sinks.write_dictionary_text(index.dictionary, f"{tmp_path}/values", with_counts=False)
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/values").where("feature_id = 0").collect()) == ["0\tblue", "1\tred"]
    exported = spark.read.text(f"{tmp_path}/feature").where("feature_id = 0")
    assert sorted(r["value"] for r in exported.collect()) == ["0\tblue\t1", "1\tred\t2"]
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/kept").collect()] == ["color 0 look", "size 0 look"]


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.createDataFrame([("old",)], "value string")
    sinks.write_lines(good, str(out))
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("new").cast("string").alias("value"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_lines(bad, str(out))
    assert spark.read.text(str(out)).first()[0] == "old" and [p.name for p in tmp_path.iterdir()] == ["out"]
    # An output may even be made from what it replaces.
    sinks.write_lines(spark.read.text(str(out)).select(F.upper("value").alias("value")), str(out))
    assert [r[0] for r in spark.read.text(str(out)).collect()] == ["OLD"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_vector_lines_ignore_extra_ids(spark):
    lines = spark.createDataFrame([("1 -1 3 9",), ("2",), ("-5 0 ",)], "value string")
    assert rows(text.parse_vectors(lines, 3)) == [(1, None, 3), (2, None, None), (None, 0, None)]


def test_row_width_audit(spark):
    lines = spark.createDataFrame([("a\tb",), ("a\t",), ("a",), ("",)], "value string")
    assert rows(text.row_width_audit(lines, 2), "width") == [(1, 2, False), (2, 2, True)]


def test_an_empty_raw_column_is_an_error(spark):
    raw = spark.createDataFrame([(1, "a", "", ""), (2, "b", "", "")], "f9 int, x string, y string, z string")
    fields = text.parse_spec(spark.createDataFrame([(0, "x 0 a"), (1, "y 0 a"), (2, "z 1 a")], "pos int, value string"))
    with pytest.raises(ValueError, match="no value in y"):
        index_features(raw, fields, keep=["f9"])
    index = index_features(raw, fields, keep=["f9"], allow_empty=True)
    assert index.columns == ["f0"] and index.encoded.columns == ["f9", "f0"]


def test_ids_beyond_32_bits_are_an_error(spark):
    dictionary = spark.createDataFrame([(0, "a", 2**31, 1)], "feature_id int, value string, value_id bigint, cnt bigint")
    with pytest.raises(ValueError, match="32-bit"):
        encode(spark.createDataFrame([("a",)], "x string"), ["x"], dictionary)
