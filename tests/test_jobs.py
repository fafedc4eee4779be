from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from logmix import jobs
from logmix.plans.extraction import LOG_COLUMNS, extract_text
from logmix.sources import sinks, text

SPEC = "color 0 a\nscore 1 a\nsize 0 a\nconst 0 b\n"
RAW = "red\t0.1\tS\tz\nblue\t0.2\tL\tz\n\t0.3\tS\tz\nred\t0.4\t\tz\nred\n"


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(path).collect())


@pytest.mark.parametrize("partition", [None, 3])
def test_index_then_cluster(spark, tmp_path, partition):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.tsv").write_text(RAW)
    (tmp_path / "spec.txt").write_text(SPEC)
    out = f"{tmp_path}/index"
    for _ in range(2):
        jobs.run_index(spark, f"{tmp_path}/raw/*.tsv", out, f"{tmp_path}/spec.txt", partition, 1000, 2)
    assert lines(spark, f"{out}/data") == ["-1 1", "0 0", "1 -1", "1 -1", "1 1"]
    assert lines(spark, f"{out}/feature/feature_id=1") == ["0\tL\t1", "1\tS\t2"]
    assert [r["value"] for r in spark.read.text(f"{out}/feature.dat").collect()] == ["color 0 a", "size 0 a"]

    for sample in (0, 1):
        model = jobs.run_cluster(spark, f"{out}/data", f"{tmp_path}/fit", 3, 2, 2, partition, sample)
        scored = lines(spark, f"{tmp_path}/fit/data")
        assert len(scored) == 5 and all(re.fullmatch(r"-?\d -?\d\t[012]", line) for line in scored)
        assert sinks.load_model(spark, f"{tmp_path}/fit/model").prior == pytest.approx(model.prior)


def test_extract(spark, tmp_path):
    cells = ["Www.Shop.com &amp; 1" if c in ("title", "displayUrl") else "x" for c in LOG_COLUMNS]
    (tmp_path / "log.tsv").write_text("\t".join(cells) + "\n")
    jobs.run_extract(spark, f"{tmp_path}/log.tsv", f"{tmp_path}/out")
    assert lines(spark, f"{tmp_path}/out") == ["x\tshop \tx\tshop \tx"]


def test_odd_lines(spark, tmp_path):
    good = "\t".join(["x"] * len(LOG_COLUMNS))
    (tmp_path / "log.tsv").write_text(f"{good}\na\tb\n")
    with pytest.raises(Exception, match="expected 63 cells, found 2"):
        jobs.run_extract(spark, f"{tmp_path}/log.tsv", f"{tmp_path}/out")
    (tmp_path / "log.tsv").write_text(f"{good}\na\tb\n\nc\td\n{good}\tmore\n")
    odd = jobs.run_extract(spark, f"{tmp_path}/log.tsv", f"{tmp_path}/out", strict=False)
    assert odd == {"cells_1": 1, "cells_2": 2, "wider": 1}
    assert len(lines(spark, f"{tmp_path}/out")) == 5
    audit = text.row_width_audit(text.read_lines(spark, f"{tmp_path}/log.tsv"), 63).where("not is_valid")
    assert audit.agg(F.sum("lines")).first()[0] == sum(odd.values())


def test_widths_are_counted_in_the_writing_pass(spark, tmp_path):
    """Counting takes no scan of its own."""
    (tmp_path / "log.tsv").write_text("a\tb\nc\n")
    watched, seen = text.observe_widths(text.read_lines(spark, f"{tmp_path}/log.tsv"), 2)
    out = extract_text(watched)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"lines": 2, "cells_1": 1, "wider": 0} and text.odd_widths(seen) == {"cells_1": 1}


def test_a_draw_does_not_depend_on_the_layout(spark, tmp_path):
    (tmp_path / "ids").write_text("".join(f"{i % 5} {i * 7 % 11}\n" for i in range(400)))
    found = {}
    for partition in (None, 3, 7):
        out = f"{tmp_path}/fit{partition}"
        jobs.run_cluster(spark, f"{tmp_path}/ids", out, 3, 2, 2, partition, how="sampled", trace=True)
        found[partition] = lines(spark, f"{out}/data")
        assert spark.read.parquet(f"{out}/trace/theta").select("iter").distinct().count() == 2
    assert found[None] == found[3] == found[7]
    with pytest.raises(ValueError, match="how"):
        jobs.run_cluster(spark, f"{tmp_path}/ids", "out", 3, 2, 2, how="x")
    jobs.run_cluster(spark, f"{tmp_path}/ids", f"{tmp_path}/p", 3, 2, 1, how="posterior", alpha=0.5, beta=0.5, prior="records", tasks=2)
    assert all(len(line.split("\t")[1].split(" ")) == 3 for line in lines(spark, f"{tmp_path}/p/data"))


def test_jobs_leave_nothing_staged(spark, tmp_path):
    from logmix import storage

    def staged():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(storage._folder(spark))
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in system.listStatus(path)] if system.exists(path) else []

    before = staged()
    (tmp_path / "raw.tsv").write_text(RAW)
    (tmp_path / "spec.txt").write_text("\n" + SPEC.replace("\n", "\n\n", 1))
    (tmp_path / "raw.tsv").write_text("".join(f"-\t{line}\n".replace("\t", "\t", 1) for line in RAW.splitlines()))
    with pytest.raises(ValueError, match="no value"):
        jobs.run_index(spark, f"{tmp_path}/raw.tsv", f"{tmp_path}/index", f"{tmp_path}/spec.txt")
    assert jobs.run_index(spark, f"{tmp_path}/raw.tsv", f"{tmp_path}/index", f"{tmp_path}/spec.txt", allow_empty=True, budget=0)
    (tmp_path / "ids").write_text("0 1\n1 0\n1 1\n")
    jobs.run_cluster(spark, f"{tmp_path}/ids", f"{tmp_path}/fit", 2, 2, 3)
    assert staged() == before


def files(folder):
    return [f for f in folder.rglob("part-*") if f.is_file()]


def test_outputs_in_parts_are_few_files(spark, tmp_path):
    """A task does not write a file into every part, and parts of any size stay whole."""
    rows = spark.range(20_000, numPartitions=20).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).cast("string").alias("part"), F.col("id").cast("int").alias("f0")
    )
    sinks.write_vector_parts(rows, ["f0"], f"{tmp_path}/parts")
    sinks.write_table(rows, f"{tmp_path}/table", by=["part"])
    for name in ("parts", "table"):
        assert len(list((tmp_path / name).glob("part=*"))) == 10
        assert len(files(tmp_path / name)) <= 10 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.text(f"{tmp_path}/parts").where("part = 0").count() == rows.where("part = '0'").count()
    values = rows.select(
        F.col("part").cast("int").alias("feature_id"), F.col("f0").cast("string").alias("value"),
        F.col("f0").alias("value_id"), F.lit(1).alias("cnt"),
    )
    sinks.write_dictionary_text(values, f"{tmp_path}/feature")
    assert len(files(tmp_path / "feature")) < 10 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_records_per_file(spark, tmp_path):
    rows = spark.range(1000, numPartitions=2).select(F.col("id").cast("int").alias("f0"), F.lit(1).alias("k"))
    sinks.write_vectors(rows, ["f0"], f"{tmp_path}/v", records_per_file=100)
    sinks.write_scores(rows, ["f0"], "k", f"{tmp_path}/s", records_per_file=250)
    assert len(files(tmp_path / "v")) == 10 and len(files(tmp_path / "s")) == 4
    assert spark.read.text(f"{tmp_path}/v").count() == spark.read.text(f"{tmp_path}/s").count() == 1000


def test_examples(spark, tmp_path):
    (tmp_path / "words").write_text("a b\na\n")
    assert {r["word"]: r["cnt"] for r in jobs.run_word_count(spark, f"{tmp_path}/words").collect()} == {"a": 2, "b": 1}
    (tmp_path / "points").write_text("1 1 2\n-1 3 -1\n")
    assert len(jobs.run_logistic_regression(spark, f"{tmp_path}/points", 2, 2)) == 2


@pytest.mark.parametrize("change", [{"cluster": 0}, {"feature": 0}, {"iteration": 0}, {"partition": 0}])
def test_options_are_checked(spark, change):
    with pytest.raises(ValueError, match="positive"):
        jobs.run_cluster(spark, "in", "out", **{"cluster": 2, "feature": 2, **change})
