"""Indexes and sketches over file sets that arrive one after the other."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from logmix import jobs
from logmix.operators import cells
from logmix.plans.growing import grow_index, moved_ids, recode
from logmix.plans.indexing import encode, index_features
from logmix.sources import sinks
from logmix.sources.text import parse_spec

MONTHS = [
    [("red", "S", "z"), ("blue", "L", "z"), ("red", "", "z")],
    [("amber", "S", "z"), ("red", "L", "z"), (None, "L", "z")],
    [("red", "M", "z"), ("zinc", "S", "z"), ("amber", "S", "z"), ("blue", "L", "z")],
]
NAMES = ["color", "size", "const"]


@pytest.fixture()
def spec(spark):
    lines = [(i, f"{name} 0 look") for i, name in enumerate(NAMES)]
    return parse_spec(spark.createDataFrame(lines, "pos int, value string"))


def table(spark, *months):
    data = [(m * 100 + i, *row) for m in months for i, row in enumerate(MONTHS[m])]
    return spark.createDataFrame(data, "id long, color string, size string, const string").repartition(3, "id")


def grown(spark, spec, months, **options):
    steps, index = [], None
    for m in months:
        index = grow_index(index, table(spark, m), spec, keep=["id"], **options)
        steps.append(index)
    return steps


@pytest.mark.parametrize("options", [{}, {"min_cutoff": 2}, {"max_cutoff": 3}, {"min_cutoff": 3, "min_exclusive": True}])
def test_month_by_month_equals_all_at_once(spark, spec, options):
    last = grown(spark, spec, [0, 1, 2], **options)[-1]
    whole = index_features(table(spark, 0, 1, 2), spec, **options, keep=["id"])
    assert rows(last.dictionary(), "feature_id", "value_id") == rows(whole.dictionary, "feature_id", "value_id")
    assert rows(last.kept, "feature_id") == rows(whole.kept, "feature_id")
    cut = last.values.join(last.kept, last.values["feature_id"] == F.col("pos"), "left_anti")
    assert cut.where("value_id is not null").count() == 0


def test_only_features_with_new_values_get_new_ids(spark, spec):
    first, second, third = grown(spark, spec, [0, 1, 2])
    assert {r["pos"] for r in moved_ids(first, second)[0].collect()} == {0}
    assert {r["pos"] for r in moved_ids(first, third)[0].collect()} == {0, 1}
    assert rows(moved_ids(second, third)[0], "pos", "value_id") == [
        (0, 0, 0, 1), (0, 1, 1, 1), (0, 2, 2, 3), (1, 0, 0, 3), (1, 1, 2, 2),
    ]


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_recode_equals_encoding_anew(spark, spec, budget):
    steps = grown(spark, spec, [0, 1, 2])
    whole = rows(index_features(table(spark, 0, 1, 2), spec, keep=["id"]).encoded, "id")
    got = []
    for m, index in enumerate(steps):
        old = encode(table(spark, m), NAMES, index.dictionary(), "id")
        got += rows(recode(old, index, steps[-1], "id", budget=budget), "id")
    assert got == whole


def test_recode_needs_raw_rows_of_entering_features(spark, spec):
    first, second, third = grown(spark, spec, [0, 1, 2], min_cutoff=3)
    assert [(r["pos"], r["name"]) for r in third.kept.orderBy("pos").collect()] == [(0, "color"), (1, "size")]
    old = encode(table(spark, 1), ["color"], second.dictionary(), "id")
    with pytest.raises(ValueError, match=r"\[1\]"):
        recode(old, second, third, "id")


def test_recode_leaves_out_features_cut_off_later(spark, spec):
    steps = grown(spark, spec, [0, 1, 2], max_cutoff=3)
    old = encode(table(spark, 0), NAMES, steps[0].dictionary(), "id")
    whole = index_features(table(spark, 0, 1, 2), spec, max_cutoff=3, keep=["id"]).encoded
    assert rows(recode(old, steps[0], steps[-1], "id"), "id") == rows(whole.where("id < 100"), "id")


def test_added_rows_without_values(spark, spec):
    (first,) = grown(spark, spec, [0])
    same = grow_index(first, table(spark, 0).limit(0), spec, keep=["id"])
    assert rows(same.values, "feature_id", "value") == rows(first.values, "feature_id", "value")
    with pytest.raises(ValueError, match="color, size, const"):
        grow_index(None, table(spark, 0).limit(0), spec, keep=["id"])
    empty = grow_index(None, table(spark, 0).limit(0), spec, keep=["id"], allow_empty=True)
    assert empty.values.count() == 0 and empty.kept.count() == 0


def test_counting_reads_only_the_added_rows(spark, spec, tmp_path):
    (first,) = grown(spark, spec, [0])
    sinks.save_index(first, str(tmp_path / "index"))
    again = sinks.load_index(spark, str(tmp_path / "index"))
    second = grow_index(again, table(spark, 1), spec, keep=["id"])
    sinks.save_index(second, str(tmp_path / "index"))
    got = rows(sinks.load_index(spark, str(tmp_path / "index")).dictionary(), "feature_id", "value_id")
    assert got == rows(grown(spark, spec, [0, 1])[-1].dictionary(), "feature_id", "value_id")


def write_months(folder: Path) -> None:
    (folder / "spec.txt").write_text("".join(f"{n} 0 look\n" for n in NAMES))
    for m, lines in enumerate(MONTHS):
        (folder / f"month{m}.tsv").write_text("".join("\t".join(v or "" for v in row) + "\n" for row in lines))


def test_index_part_job_equals_index_job(spark, tmp_path):
    write_months(tmp_path)
    out, whole, spec = str(tmp_path / "parts"), str(tmp_path / "whole"), str(tmp_path / "spec.txt")
    for m in range(3):
        assert jobs.run_index_part(spark, str(tmp_path / f"month{m}.tsv"), out, spec, f"2024-0{m + 1}") == NAMES
    jobs.run_index(spark, str(tmp_path / "month*.tsv"), whole, spec)
    vectors = lambda path: sorted(r["value"] for r in spark.read.text(path).collect())
    assert vectors(f"{out}/data") == vectors(f"{whole}/data")
    assert vectors(f"{out}/data/part=2024-01") == sorted(["2 2 0", "1 0 0", "2 -1 0"])
    assert rows(spark.read.text(f"{out}/feature"), "feature_id", "value") == rows(spark.read.text(f"{whole}/feature"), "feature_id", "value")
    assert vectors(f"{out}/feature.dat") == vectors(f"{whole}/feature.dat")
    before = vectors(f"{out}/data")
    with pytest.raises(ValueError, match="2024-02"):
        jobs.run_index_part(spark, str(tmp_path / "month1.tsv"), out, spec, "2024-02")
    with pytest.raises(PySparkException):
        jobs.run_index_part(spark, str(tmp_path / "nothing.tsv"), out, spec, "2024-04")
    assert vectors(f"{out}/data") == before and sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("_")) == []


def test_united_sketches_equal_one_pass(spark, tmp_path):
    data = spark.range(30_000).select(
        (F.col("id") % 3).alias("part"), F.hash("id").cast("string").alias("a"), (F.col("id") % 50).cast("string").alias("b"),
        F.lit(None).cast("string").alias("c"),
    )
    for part in range(3):
        mine = cells.value_sketches(data.where(F.col("part") == part), ["a", "b", "c"])
        sinks.add_sketches(mine, str(tmp_path), str(part))
    sinks.add_sketches(cells.value_sketches(data.where("part = 1"), ["a", "b", "c"]), str(tmp_path), "1")
    united = cells.sketched_cardinality(cells.united_sketches(spark.read.parquet(str(tmp_path))))
    once = cells.sketched_cardinality(cells.united_sketches(cells.value_sketches(data, ["a", "b", "c"])))
    single = cells.approx_cardinality(data.coalesce(1), ["a", "b", "c"])
    grouped = cells.sketched_cardinality(cells.united_sketches(cells.value_sketches(data, ["a", "b", "c"], by=["part"])))
    assert rows(united, "feature_id") == rows(once, "feature_id") == rows(grouped, "feature_id") == rows(single, "feature_id")
    exact = {0: data.select("a").distinct().count(), 1: 50, 2: 0}
    assert all(abs(n - exact[d]) <= 0.05 * exact[d] for d, n in rows(united, "feature_id"))


def test_sketches_of_other_precision_are_not_united(spark):
    data = spark.range(100).select(F.col("id").cast("string").alias("a"))
    both = cells.value_sketches(data, ["a"], 0.01).unionByName(cells.value_sketches(data, ["a"], 0.05))
    with pytest.raises(PySparkException):
        cells.united_sketches(both).collect()
