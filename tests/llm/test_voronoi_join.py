"""The Voronoi join against brute force, on given, hostile, clustered and empty tables."""

from __future__ import annotations

import math

import brute
import numpy as np
import pytest

from logmix.llm import voronoi_join as vj
from logmix.llm.queries import QUERIES

NAME = "op12_voronoi_join"


def scaled(vector):
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    whole = [math.floor(256 * x) for x in vector]
    return whole if sum(x * x for x in whole) < 2**62 else None


def expected(rows, top=5, every=50):
    rows = {(i, tuple(v)) for i, raw in rows if i is not None and (v := scaled(raw))}
    if not rows:
        return []
    lengths = [len(v) for _, v in rows]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = [r for r in rows if len(r[1]) == width]
    out = []
    for i, q in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:top]
            out += [(i, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("kind", ["given", "hostile", "empty"])
def test_query(spark, tmp_path, kind):
    folder = "/root/testdata/sf0.001" if kind == "given" else brute.write_tables(tmp_path, kind == "empty")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(QUERIES[NAME](spark, folder)) == expected(rows)


def table(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("slice_rows", [40, 16_384])
def test_clusters_are_pruned(spark, monkeypatch, slice_rows):
    """Far clusters send nothing to a group, and a hot vector that a third of the rows repeat loses nothing."""
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(8, 6)) * 40
    rows = [(i, (middles[i % 8] + draw.normal(size=6) * 0.1).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    seen = []
    limits = vj.thresholds

    def spy(*args):
        seen.append((args, limits(*args)))
        return seen[-1][1]

    monkeypatch.setattr(vj, "thresholds", spy)
    frame = table(spark, rows)
    settings = vj.Settings(pivots=8, slice_rows=slice_rows, query_batch=7)
    assert found(vj.search(frame, frame["vec_id"] % 50 == 0, "vec_id", "embedding", 5, settings)) == expected(rows)
    (pivots, sizes, radii, query_radii, _), bounds = seen[0]
    norms = np.sqrt((pivots**2).sum(axis=1))
    highest = pivots @ pivots.T + query_radii[:, None] * norms + norms[:, None] * radii + query_radii[:, None] * radii
    assert ((highest >= bounds[:, None]) * sizes).sum() < 0.6 * len(pivots) * len(rows)


def test_thresholds_hold():
    """At least as many vectors as asked for reach a group's threshold, for every query in it."""
    draw = np.random.default_rng(4)
    x, pivots = draw.integers(-300, 300, (500, 5)).astype(float), draw.integers(-300, 300, (6, 5)).astype(float)
    cell = vj._nearest(x, pivots)
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
    sizes = np.bincount(cell, minlength=6)
    radii = np.array([far[cell == k].max(initial=0) for k in range(6)])
    limits = vj.thresholds(pivots, sizes, radii, radii, 9)
    for i, q in zip(cell, x):
        assert (x @ q >= limits[i]).sum() >= 9


def test_large_numbers_stay_exact(spark):
    big = [(50 * i, [float(2**20 + i), -3.7, 2.0**19 - i]) for i in range(12)] + [(1, [2.0**30, 0.0, 0.0]), (2, [1e300, 1.0, 1.0])]
    frame = table(spark, big)
    assert found(vj.search(frame, frame["vec_id"] % 50 == 0, "vec_id", "embedding")) == expected(big)
    a = np.array([[2**30, 1, -7]], np.int64)
    assert vj.products(a, a).tolist() == [[2**60 + 50]]
