from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from logmix.functions.uniform import uniform
from logmix.functions.vectors import add_vectors, dot
from logmix.operators import mixture as mx
from logmix.operators import kernel
from logmix.operators.kernel import RECORD_MASS, sample_clusters
from logmix.plans.clustering import Model, _merged, assign, data_domain, distinct_patterns, estep_statistics, fit, posterior
from logmix.plans.fit_state import FitState
from logmix.sources import sinks
from logmix.storage import stage

COLUMNS = ["f0", "f1"]
DATA = [(1, 0), (1, 1), (0, 0), (1, None)]
THETA = {0: [[0.125, 0.875], [4 / 7, 3 / 7]], 1: [[2 / 3, 1 / 3], [0.6, 0.4]]}
# One case per physical path: the model as a broadcast, and joined to the data.
PATHS = pytest.mark.parametrize("model_bytes", [mx.MODEL_BYTES, 0], ids=["broadcast", "joined"])


def table(theta, spark):
    cells = [
        (d, v, k, p) for d, by_k in theta.items() for k, by_v in enumerate(by_k) for v, p in enumerate(by_v)
    ]
    return spark.createDataFrame(cells, "feature_id int, value_id int, k int, p double")


@pytest.fixture()
def data(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DATA)], "id int, f0 int, f1 int")


@pytest.fixture()
def start(spark):
    return table(THETA, spark), [0.5, 0.5]


@pytest.fixture()
def model(spark, data, start):
    return Model(*start, data_domain(distinct_patterns(data, COLUMNS), COLUMNS))


def brute_force(data, theta, prior, mode, per, iterations):
    """The same fit with plain loops."""
    clusters, sizes = len(prior), {d: len(t[0]) for d, t in theta.items()}
    for _ in range(iterations):
        n = {d: [[0.0] * sizes[d] for _ in prior] for d in theta}
        mass = [0.0] * clusters
        for row in data:
            r = [prior[k] * math.prod(theta[d][k][v] for d, v in enumerate(row) if v is not None) for k in range(clusters)]
            r = [x / sum(r) for x in r]
            if mode == "hard":
                r = [float(k == r.index(max(r))) for k in range(clusters)]
            for k in range(clusters):
                present = [(d, v) for d, v in enumerate(row) if v is not None]
                for d, v in present:
                    n[d][k][v] += r[k]
                mass[k] += r[k] * (len(present) if per == "cells" else 1)
        theta = {
            d: [[(1 / sizes[d] + x) / (1 + sum(n[d][k])) for x in n[d][k]] for k in range(clusters)] for d in theta
        }
        prior = [(1 / clusters + m) / (1 + sum(mass)) for m in mass]
    return theta, prior


def close(df, expected, column="p"):
    got = {(r["feature_id"], r["value_id"], r["k"]): r[column] for r in df.collect()}
    want = {(d, v, k): p for d, t in expected.items() for k, by_v in enumerate(t) for v, p in enumerate(by_v)}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


@PATHS
def test_posterior(data, model, model_bytes):
    got = posterior(data, COLUMNS, model, model_bytes=model_bytes).orderBy("id").collect()
    assert [round(r["p"][0], 6) for r in got] == [0.694051, 0.62982, 0.195531, 0.671233]
    assert all(abs(sum(r["p"]) - 1) < 1e-12 for r in got)
    best = assign(data, COLUMNS, model, how="argmax", model_bytes=model_bytes).orderBy("id").collect()
    assert [r["cluster"] for r in best] == [0, 0, 1, 0]


@PATHS
@pytest.mark.parametrize(
    "hard, expected",
    [
        (False, [0.195531, 0.804469, 1.995104, 1.004896, 0.889582, 1.110418, 0.62982, 0.37018]),
        (True, [0, 1, 3, 0, 1, 1, 1, 0]),
    ],
)
def test_statistics(data, start, model, model_bytes, hard, expected):
    patterns = distinct_patterns(data, COLUMNS, True)
    broadcast = {0, 1} if model_bytes else {1}
    stats = estep_statistics(patterns, COLUMNS, *start, model.domain, hard, broadcast)
    got = rows(stats.where("feature_id >= 0"), "feature_id", "value_id", "k")
    assert [round(r[3], 6) for r in got] == expected
    assert abs(sum(r[3] for r in got) - 7) < 1e-9
    assert stats.where(F.col("feature_id") == RECORD_MASS).agg(F.sum("n")).first()[0] == pytest.approx(4)


@PATHS
@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("mode, prior", [("soft", "cells"), ("soft", "records"), ("hard", "cells"), ("hard", "records")])
def test_fit_equals_brute_force(data, start, mode, prior, model_bytes, collapse):
    got = fit(data, COLUMNS, 2, 2, mode=mode, prior=prior, start=start, collapse=collapse, model_bytes=model_bytes)
    theta, weights = brute_force(DATA, THETA, [0.5, 0.5], mode, prior, 2)
    close(got.theta, theta)
    assert got.prior == pytest.approx(weights)


def test_one_iteration_by_hand(data, start):
    soft = fit(data, COLUMNS, 2, 1, start=start)
    close(soft.theta.withColumn("p", F.round("p", 6)), {
        0: [[0.217991, 0.782009], [0.464329, 0.535671]], 1: [[0.551552, 0.448448], [0.649206, 0.350794]],
    })
    assert [round(p, 6) for p in soft.prior] == [0.526255, 0.473745]
    hard = fit(data, COLUMNS, 2, 1, start=start, mode="hard", keep_trace=True)
    close(hard.theta, {0: [[0.125, 0.875], [0.75, 0.25]], 1: [[0.5, 0.5], [0.75, 0.25]]})
    assert hard.prior == pytest.approx([0.6875, 0.3125])
    assert fit(data, COLUMNS, 2, 1, start=start, mode="hard", prior="records").prior == pytest.approx([0.7, 0.3])
    assert sinks.trace_table(hard).where("iter = 1 and feature_id >= 0").count() == 8


def wide(spark, n=600):
    """Four features; ids have gaps, cells are missing, and a third of the rows are the same."""
    pick = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    cell = lambda d, size: F.when(F.pmod(pick, F.lit(5 + d)) != 4, F.pmod(F.hash(pick, F.lit(d)), F.lit(size)) * 3)
    return spark.range(n).select("id", *[cell(d, s).cast("int").alias(f"f{d}") for d, s in enumerate([2, 3, 7, 40])])


@pytest.mark.parametrize("mode", ["soft", "hard"])
def test_joined_path_equals_broadcast(spark, mode):
    columns = ["f0", "f1", "f2", "f3"]
    data = wide(spark)
    one = fit(data, columns, 3, 3, mode=mode, seed=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        # Room for the two smallest features; the other two are joined.
        two = fit(data, columns, 3, 3, mode=mode, seed=5, model_bytes=5 * 3 * 8)
        key = ["feature_id", "value_id", "k"]
        a, b = rows(one.theta.select(*key, "p"), *key), rows(two.theta.select(*key, "p"), *key)
        assert [r[:3] for r in a] == [r[:3] for r in b]
        assert np.allclose([r[3] for r in a], [r[3] for r in b], atol=1e-9)
        for how in ("argmax", "sampled"):
            c = assign(data, columns, one, how=how, keys=["id"])
            d = assign(data, columns, one, how=how, keys=["id"], model_bytes=5 * 3 * 8)
            assert rows(c, "id") == rows(d, "id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_stay_where_they_are(spark):
    """An iteration with joined features moves neither the stored cells nor the rows, only what the cells found."""
    columns = ["f0", "f1", "f2", "f3"]
    patterns = distinct_patterns(wide(spark), columns, False)
    domain = stage(data_domain(patterns, columns), "domain")
    layout = mx.co_partition(patterns, columns, domain, [2, 3])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert layout.hot  # a third of the rows share one value
        plan = layout.with_logs(mx.random_theta(domain, 3, 1), None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        layout.drop()
    # The one exchange is of the lists on their way to the rows.
    assert plan.count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(_row#\d+L, 8\)", plan)
    assert plan.count("Bucketed: true") == 3


def test_sums_are_grouped_where_tasks_are_many(spark, monkeypatch):
    monkeypatch.setattr(mx, "GROUP_TASKS", 3)
    columns = ["f0", "f1", "f2", "f3"]
    patterns = distinct_patterns(wide(spark), columns, False, tasks=8)
    assert patterns.rdd.getNumPartitions() == 8
    domain = stage(data_domain(patterns, columns), "domain")
    theta, prior = mx.random_theta(domain, 3, 1), [0.2, 0.3, 0.5]
    one, many = (rows(estep_statistics(patterns, columns, theta, prior, domain, tasks=n), "feature_id", "value_id", "k") for n in (1, 8))
    assert [r[:3] for r in one] == [r[:3] for r in many] and np.allclose([r[3] for r in one], [r[3] for r in many])
    plan = estep_statistics(patterns, columns, theta, prior, domain, tasks=8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(_group#\d+, feature_id#\d+, value_id#\d+, 8\)", plan)


def test_input_splits_are_kept(spark):
    table = stage(wide(spark).repartition(40), "many")
    sizes = {0: 2, 1: 3}
    assert _merged(table, None, sizes, {0, 1}, 10_000)[1] == table.rdd.getNumPartitions()
    # Sums of a model as large as a split's cells are not worth a task for each split.
    assert _merged(table, None, {0: 10_000}, {0}, 10_000)[1] == 8
    assert _merged(table, 3, sizes, {0, 1}, 10_000)[0].rdd.getNumPartitions() == 3


@pytest.mark.parametrize("tasks", [None, 1, 20])
def test_a_stored_input_is_left_alone(spark, data, tasks):
    table = stage(data, "given")
    spread, plain = fit(table, COLUMNS, 2, 1, seed=1, stored=True, collapse=False, tasks=tasks), fit(data, COLUMNS, 2, 1, seed=1)
    assert table.count() == len(DATA) and spread.prior == pytest.approx(plain.prior)


class Stopped(Exception):
    pass


@PATHS
def test_a_stopped_fit_goes_on(spark, data, tmp_path, monkeypatch, model_bytes):
    """Stopped in iteration 4 of 5, with that iteration's statistics written already."""
    options = {"seed": 2, "model_bytes": model_bytes, "state": f"{tmp_path}/state"}
    straight = fit(data, COLUMNS, 2, 5, seed=2, model_bytes=model_bytes)
    finish = FitState.finish

    def stop(self, i, *rest):
        if i == 4:
            raise Stopped
        return finish(self, i, *rest)

    monkeypatch.setattr(FitState, "finish", stop)
    before = spark.catalog.listTables()
    with pytest.raises(Stopped):
        fit(data, COLUMNS, 2, 5, **options)
    assert spark.catalog.listTables() == before  # nothing is left in buckets
    monkeypatch.setattr(FitState, "finish", finish)
    steps = []
    monkeypatch.setattr(mx, "update_prior", lambda *a, f=mx.update_prior: steps.append(1) or f(*a))
    resumed = fit(data, COLUMNS, 2, 5, **options)
    assert len(steps) == 2 and resumed.prior == pytest.approx(straight.prior)
    close_tables(resumed.theta, straight.theta)
    assert [len(t[2]) for t in resumed.trace] == [2] * 5
    assert rows(resumed.state.table().select("iter").distinct(), "iter") == [(i,) for i in range(1, 6)]
    assert len(steps) == 2 and fit(data, COLUMNS, 2, 3, **options).prior == resumed.trace[2][2]
    with pytest.raises(ValueError, match="other"):
        fit(data, COLUMNS, 2, 5, **{**options, "seed": 3})


def close_tables(a, b):
    key = ["feature_id", "value_id", "k"]
    a, b = rows(a.select(*key, "p"), *key), rows(b.select(*key, "p"), *key)
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b])


@pytest.mark.parametrize("joined", [[], [0], [0, 1]])
def test_partial_sums_that_outgrow_a_task(monkeypatch, joined):
    """Sums passed on early add up to the same totals, and a hot value is passed on once."""
    import pyarrow as pa

    monkeypatch.setattr(kernel, "_HELD_NUMBERS", 60)
    monkeypatch.setattr(kernel, "_KEPT_NUMBERS", 4)
    monkeypatch.setattr(kernel, "_BLOCK_NUMBERS", 64)
    draw = np.random.default_rng(0)
    theta = draw.random((2, 50, 2))
    dense = [d for d in (0, 1) if d not in joined]
    model = kernel.LogModel(
        np.vstack([*[np.log(theta[d]) for d in dense], np.zeros((1, 2))]),
        np.log([0.4, 0.6]),
        [np.arange(0) if d in joined else np.arange(50) for d in (0, 1)],
        [50 * dense.index(d) if d in dense else 0 for d in (0, 1)],
        joined,
    )
    ids = draw.integers(0, 50, (400, 2))
    ids[::3, 0] = 7  # a third of the rows

    def batches():
        for start in range(0, 400, 40):
            part = ids[start : start + 40]
            logs = [pa.array([[np.log(theta[d][v[d]]) for d in joined] for v in part])] if joined else []
            columns = [pa.array(part[:, 0]), pa.array(part[:, 1]), *logs, pa.array(np.ones(40))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    got, times = {}, {}
    for batch in kernel.partial_statistics(model, batches(), False):
        for row in batch.to_pylist():
            key = row["feature_id"], row["value_id"]
            got[key] = got.get(key, 0) + np.array(row["n"])
            times[key] = times.get(key, 0) + 1
    p = np.array([0.4, 0.6]) * theta[0][ids[:, 0]] * theta[1][ids[:, 1]]
    p /= p.sum(axis=1, keepdims=True)
    for d in (0, 1):
        for v in np.unique(ids[:, d]):
            assert np.allclose(got[d, v], p[ids[:, d] == v].sum(axis=0))
    assert np.allclose(got[RECORD_MASS, 0], p.sum(axis=0)) and times[0, 7] == 1
    if joined:
        assert max(times.values()) > 1


def test_sums_of_sorted_batches_hold_one_key():
    draw = np.random.default_rng(2)
    keys = np.sort(draw.integers(0, 40, 500))
    n = draw.random((500, 3))
    cut = [0, 0, 1, 7, 90, 91, 400, 500]
    batches = [b for a, e in zip(cut, cut[1:]) for b in kernel._statistics(keys[a:e] // 7 - 1, keys[a:e] % 7, n[a:e])]
    got = [r for batch in kernel.summed_statistics(iter(batches), 3) for r in batch.to_pylist()]
    assert [(r["feature_id"] + 1) * 7 + r["value_id"] for r in got] == np.unique(keys).tolist()
    assert np.allclose([r["n"] for r in got], [n[keys == k].sum(axis=0) for k in np.unique(keys)])
    assert list(kernel.summed_statistics(iter([]), 3)) == []


def test_a_value_rare_in_training_and_hot_in_scoring(spark):
    train = spark.createDataFrame([(i % 20, i % 3) for i in range(200)] + [(99, 0)], "f0 int, f1 int")
    model = fit(train, COLUMNS, 2, 1, seed=1)
    odd = spark.range(3000).select("id", F.lit(99).alias("f0"), (F.col("id") % 3).cast("int").alias("f1"))
    one, two = (posterior(odd, COLUMNS, model, model_bytes=b).orderBy("id").collect() for b in (mx.MODEL_BYTES, 0))
    assert np.allclose([r["p"] for r in one], [r["p"] for r in two])


def test_totals_are_broadcast(spark, model):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for theta in (mx.random_theta(model.domain, 3, 1), mx.uniform_theta(model.domain, 3)):
            assert "SortMergeJoin" not in theta._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distributions_sum_to_one_and_the_likelihood_rises(spark):
    columns = ["f0", "f1", "f2", "f3"]
    data = wide(spark).select(*columns)
    model = fit(data, columns, 3, 6, prior="records", seed=3, keep_trace=True)
    sums = model.theta.groupBy("feature_id", "k").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 12 and all(abs(r["s"] - 1) < 1e-9 for r in sums) and abs(sum(model.prior) - 1) < 1e-12
    cells = [tuple(r) for r in data.collect()]
    sizes = {r["feature_id"]: r["v"] for r in model.domain.groupBy("feature_id").agg(F.count("*").alias("v")).collect()}
    objective = []
    for _, theta, prior in model.trace:
        p = {(r["feature_id"], r["value_id"], r["k"]): r["p"] for r in theta.collect()}
        fitted = sum(
            math.log(sum(w * math.prod(p[d, v, k] for d, v in enumerate(row) if v is not None) for k, w in enumerate(prior)))
            for row in cells
        )
        pseudo = sum(math.log(x) / sizes[d] for (d, _, _), x in p.items()) + sum(math.log(w) / 3 for w in prior)
        objective.append(fitted + pseudo)
    assert all(b >= a - 1e-9 for a, b in zip(objective, objective[1:]))


def test_many_features_do_not_underflow(spark):
    columns = [f"f{d}" for d in range(200)]
    data = spark.range(40).select(*[(F.hash("id", F.lit(d)) % 50 + 50).alias(c) for d, c in enumerate(columns)])
    model = fit(data, columns, 2, 1, seed=1)
    scored = posterior(data, columns, model).agg(F.min(F.col("p")[0] + F.col("p")[1])).first()[0]
    assert scored == pytest.approx(1.0)


@PATHS
def test_rows_without_cells_score_as_the_prior(spark, model, model_bytes):
    empty = spark.createDataFrame([(None, -1)], "f0 int, f1 int")
    assert posterior(empty, COLUMNS, model, model_bytes=model_bytes).first()["p"] == pytest.approx([0.5, 0.5])


@PATHS
def test_value_outside_the_model_is_an_error(spark, model, model_bytes):
    odd = spark.createDataFrame([(5, 0)], "f0 int, f1 int")
    with pytest.raises(Exception, match="not in the model"):
        posterior(odd, COLUMNS, model, model_bytes=model_bytes).collect()


@pytest.mark.parametrize("u, cluster", [(0.2, 0), (0.21, 1), (0.69, 1), (0.95, 2), (1.0, 2), (0.0, 0)])
def test_sampled_cluster(u, cluster):
    assert sample_clusters(np.array([[0.2, 0.5, 0.3]]), np.array([u])).tolist() == [cluster]


def test_rounding_gap_goes_to_the_last_cluster_with_mass():
    assert sample_clusters(np.array([[0.5, 0.5 - 1e-12, 0.0]]), np.array([1.0])).tolist() == [1]


def test_sampling_is_independent_of_partitioning(data, model):
    one = rows(assign(data.repartition(1), COLUMNS, model, keys=["id"], seed=4), "id")
    assert one == rows(assign(data.repartition(5), COLUMNS, model, keys=["id"], seed=4), "id")
    with pytest.raises(ValueError):
        assign(data, COLUMNS, model)


def test_sampled_shares_follow_the_posterior(spark, model):
    many = spark.range(20_000).select("id", F.lit(1).alias("f0"), F.lit(0).alias("f1"))
    share = assign(many, COLUMNS, model, keys=["id"]).agg(F.avg((F.col("cluster") == 0).cast("int"))).first()[0]
    assert share == pytest.approx(0.694051, abs=0.02)


def test_start_models(spark, model):
    uniform_rows = rows(mx.uniform_theta(model.domain, 3).select("p").distinct())
    assert uniform_rows == [(0.5,)]
    one, two = (rows(mx.random_theta(d, 2, 7), "feature_id", "value_id", "k") for d in (model.domain, model.domain.repartition(3)))
    assert one == two
    assert one != rows(mx.random_theta(model.domain, 2, 8), "feature_id", "value_id", "k")
    assert sum(mx.random_prior(5, 1)) == pytest.approx(1)
    spread = spark.range(10_000).select(uniform(1, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert spread[0] == pytest.approx(0.5, abs=0.02) and spread[1] < 0.01 and spread[2] > 0.99 and spread[2] < 1


def test_saved_model_scores_alike(spark, data, start, tmp_path):
    model = fit(data, COLUMNS, 2, 2, start=start)
    for _ in range(2):
        sinks.save_model(model, f"{tmp_path}/model")
    again = sinks.load_model(spark, f"{tmp_path}/model")
    assert rows(posterior(data, COLUMNS, again), "id") == rows(posterior(data, COLUMNS, model), "id")
    sinks.write_scores(assign(data, COLUMNS, again, how="argmax"), COLUMNS, "cluster", f"{tmp_path}/hard")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/hard").collect()) == ["0 0\t1", "1 -1\t0", "1 0\t0", "1 1\t0"]
    sinks.write_scores(posterior(data, COLUMNS, again), COLUMNS, "p", f"{tmp_path}/soft")
    ids, p = spark.read.text(f"{tmp_path}/soft").where("value like '1 1%'").first()[0].split("\t")
    assert ids == "1 1" and sum(map(float, p.split(" "))) == pytest.approx(1)


@pytest.mark.parametrize("change", [{"clusters": 0}, {"iterations": 0}, {"columns": []}, {"mode": "x"}, {"prior": "x"}])
def test_arguments_are_checked(data, change):
    options = {"columns": COLUMNS, "clusters": 2, "iterations": 1, **change}
    with pytest.raises(ValueError):
        fit(data, **options)


def test_vector_functions(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one.select(add_vectors(arr(1.0, 2.0), arr(0.5, 3.0)).alias("v")).first()[0] == [1.5, 5.0]
    with pytest.raises(Exception, match="differ in length"):
        one.select(add_vectors(arr(1.0), arr(0.5, 3.0)).alias("v")).collect()
    assert one.select(dot([1, 2], [F.lit(3), F.lit(4)]).alias("v")).first()[0] == 11.0
