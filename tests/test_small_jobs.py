from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from logmix import storage
from logmix.operators.cells import approx_cardinality, cardinality, encoded_value_counts, largest_domain, value_counts
from logmix.plans.logistic import components, gradient, start_weights, train_logistic
from logmix.sources import sinks, text


@pytest.fixture()
def points(spark):
    return spark.createDataFrame([(1.0, [1.0, 2.0]), (-1.0, [3.0, -1.0])], "y double, x array<double>")


def test_gradient_by_hand(points):
    x = components(points, "x", 2)
    assert rows(gradient(points, F.col("y"), x, [0.0, 0.0])) == [(1.0, -1.5)]
    assert train_logistic(points, F.col("y"), x, 1, weights=[0.0, 0.0]) == [-1.0, 1.5]


def test_training_equals_numpy(spark, tmp_path):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 16))
    y = np.where(x @ draw.normal(size=16) > 0, 1.0, -1.0)
    lines = [" ".join(map(repr, map(float, [label, *row]))) + " 99" for label, row in zip(y, x)]
    (tmp_path / "points.dat").write_text("\n".join(lines) + "\n")
    data = text.read_labelled(spark, str(tmp_path / "points.dat"))
    w = np.array(start_weights(16))
    for _ in range(5):
        w = w - 0.01 * (((1 / (1 + np.exp(-y * (x @ w))) - 1) * y) @ x)
    got = train_logistic(data, F.col("y"), components(data, "x", 16), 5, step=0.01)
    assert np.allclose(got, w)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_start_weights():
    assert start_weights(16) == start_weights(16) != start_weights(16, 1)
    assert all(-1 <= w < 1 for w in start_weights(1000))


def test_extreme_margins_stay_finite(spark):
    data = spark.createDataFrame([(1.0, [1e6]), (-1.0, [1e6])], "y double, x array<double>")
    assert np.isfinite(train_logistic(data, F.col("y"), components(data, "x", 1), 2, weights=[1.0])).all()


def test_counts_with_a_hot_value(spark):
    """A third of the rows hold one value; missing cells do not count."""
    data = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"),
        F.when(F.col("id") % 2 == 0, "").alias("b"),
        F.lit("z").alias("c"),
    )
    counts = value_counts(data, ["a", "b", "c"], [0, 1, 2])
    assert counts.where("value = 'hot'").first()["cnt"] == 10_000
    assert rows(cardinality(counts), "feature_id") == [(0, 20_001), (2, 1)]
    assert largest_domain(cardinality(counts)).first()[0] == 20_001
    approx = rows(approx_cardinality(data, ["a", "c"]), "feature_id")
    assert abs(approx[0][1] - 20_001) < 1_000 and approx[1] == (1, 1)
    fine = rows(approx_cardinality(data, ["a"], 0.001))
    assert abs(fine[0][1] - 20_001) < 100
    with pytest.raises(ValueError):
        approx_cardinality(data, ["a"], 1e-6)


def test_encoded_counts(spark):
    data = spark.createDataFrame([(0, 2, 3), (0, -1, 2), (None, 2, 1)], "f0 int, f1 int, w int")
    assert rows(encoded_value_counts(data, ["f0", "f1"], "w"), "feature_id") == [(0, 0, 5, 2), (1, 2, 4, 2)]
    assert rows(encoded_value_counts(data, ["f0", "f1"]), "feature_id") == [(0, 0, 2, 2), (1, 2, 2, 2)]


def test_stage_keeps_rows_and_columns(spark):
    data = spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string")
    stored = storage.stage(data, "t", by=["g"])
    assert stored.columns == ["g", "v"] and rows(stored, "g") == rows(data, "g")
    assert stored.inputFiles()[0].split("//")[-1].startswith(spark.conf.get("spark.checkpoint.dir"))


def test_drop_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    (tmp_path / "other").write_text("kept")
    storage.stage(spark.range(3), "t")
    assert len(list(tmp_path.iterdir())) == 2
    storage.drop_staged(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(storage, "_default_folder", lambda _: "file:/tmp/staging")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    monkeypatch.setattr(storage, "_default_folder", lambda _: "hdfs://a/tmp/staging")
    assert storage.shared_folder(Session()) == "hdfs://a/tmp/staging"


def test_numbers_are_taken_at_the_scan(spark, tmp_path):
    sinks.write_table(spark.range(1000).repartition(3), f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plain = {r["id"]: r[text.LINE] for r in text.numbered(stored).collect()}
    moved = text.numbered(stored, 7)
    assert moved.rdd.getNumPartitions() == 7 and plain == {r["id"]: r[text.LINE] for r in moved.collect()}
    assert text.numbered(stored).rdd.getNumPartitions() == stored.rdd.getNumPartitions()


def test_scratch_is_deleted(spark):
    with pytest.raises(KeyError), storage.scratch(spark):
        kept = storage.stage(spark.range(3), "t")
        path = storage.staged_path(kept)
        assert kept.count() == 3
        raise KeyError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    outside = storage.stage(spark.range(3).selectExpr("id", "id AS k"), "t", by=["k"])
    path = storage.staged_path(outside)
    storage.drop_table(outside)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
