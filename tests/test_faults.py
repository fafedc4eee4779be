"""Lines with malformed numbers, under both ANSI settings."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from conftest import rows
from logmix import jobs
from logmix.sources import text


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", old)


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "n int, value string")


def test_vectors(spark, ansi):
    given = ["1 -1 3", "1 x 3", "99999999999 2 3", "1", "", None, "1  3 y", "1.5 2 x", "x 2147483648 3", "+7 -0 2147483647"]
    checked = text.checked_vectors(lines(spark, *given), 3, "n")
    assert rows(text.sound(checked), "n") == [
        (0, 1, None, 3), (3, 1, None, None), (4, None, None, None), (5, None, None, None), (6, 1, None, 3), (9, 7, 0, 2147483647),
    ]
    assert rows(text.rejected(checked, "n"), "n") == [
        (1, "1: not_a_number", "1 x 3"), (2, "0: out_of_range", "99999999999 2 3"),
        (7, "0: not_a_number", "1.5 2 x"), (8, "0: not_a_number", "x 2147483648 3"),
    ]
    assert rows(text.parse_vectors(lines(spark, "1 2 x"), 2)) == [(1, 2)]
    with pytest.raises(PySparkException, match="1: not_a_number in line: 1 x 3"):
        text.parse_vectors(lines(spark, "1 2 3", "1 x 3"), 3).collect()


def test_labelled(spark, ansi):
    given = ["1 0.5 -2e1", "-1 .5 3. 9 x", "1 2", "", None, "NaN 1 2", "1 Infinity 2", "1 1e999 2", "1  2", "1 0x1p3 2", "1 2f 3"]
    checked = text.checked_labelled(lines(spark, *given), 2, "n")
    assert rows(text.sound(checked), "n") == [(0, 1.0, [0.5, -20.0]), (1, -1.0, [0.5, 3.0])]
    assert [(r["n"], r["fault"]) for r in text.rejected(checked, "n").orderBy("n").collect()] == [
        (2, "too_few_numbers"), (3, "0: not_a_number"), (4, "too_few_numbers"), (5, "0: not_a_number"),
        (6, "1: not_a_number"), (7, "1: out_of_range"), (8, "1: not_a_number"), (9, "1: not_a_number"), (10, "1: not_a_number"),
    ]
    with pytest.raises(PySparkException, match="too_few_numbers in line: 1 2"):
        text.parse_labelled(lines(spark, "1 2"), 2).collect()


def test_no_lines(spark):
    assert text.sound(text.checked_vectors(lines(spark).where("n < 0"), 2)).count() == 0
    assert text.rejected(text.checked_labelled(lines(spark).where("n < 0"), 2)).count() == 0


def test_cluster_job_sets_bad_lines_apart(spark, ansi, tmp_path):
    good = ["0 1", "1 0", "0 -1", "1 1"] * 5
    (tmp_path / "in.txt").write_text("\n".join([*good, "0 x", "77777777777 1"]) + "\n")
    (tmp_path / "good.txt").write_text("\n".join(good) + "\n")
    out, clean = str(tmp_path / "out"), str(tmp_path / "clean")
    jobs.run_cluster(spark, str(tmp_path / "in.txt"), out, 2, 2, 3, strict=False, how="argmax")
    jobs.run_cluster(spark, str(tmp_path / "good.txt"), clean, 2, 2, 3, how="argmax")
    read = lambda path: sorted(r["value"] for r in spark.read.text(path).collect())
    assert read(f"{out}/rejected") == ["0: out_of_range\t77777777777 1", "1: not_a_number\t0 x"]
    assert read(f"{out}/data") == read(f"{clean}/data")
    with pytest.raises(PySparkException, match="not_a_number|out_of_range"):
        jobs.run_cluster(spark, str(tmp_path / "in.txt"), out, 2, 2, 3)


def test_one_scan(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1 2\n3 x\n")
    checked = text.checked_vectors(spark.read.text(str(tmp_path / "in.txt")), 2)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
