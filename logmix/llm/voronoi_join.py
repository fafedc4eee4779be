"""Exact search for the largest integer inner products by a Voronoi join.

Each component x becomes floor(256 x). Pivots cut the space into cells; a vector belongs to the cell of its nearest pivot.

1. Summaries: each cell's number of vectors, its radius (largest distance to the pivot) and, for the queries in it, theirs.
   There is one row per cell, so they meet on the driver.
2. Bounds: for a query q of group i, with pivot p and radius R, and a vector x of cell j, with pivot c and radius r,
   q.x lies within R|c| + |p|r + Rr of p.c. A group's threshold is the largest t such that cells whose lower bound is t or
   more hold enough vectors; every query of the group finds as many scores of at least t.
3. Replication: a vector goes to the groups where p.x + R|x|, its own bound, reaches the threshold, and to no other.
4. Local search: a group's vectors are dealt over slices of about ``slice_rows``, and its queries go to every slice. A task
   holds one slice at a time, streams the queries past it in batches, and passes on each query's best. The best of all slices
   are ranked by a window.

Bounds are widened by a millionth, so rounding loses nothing; scores are computed in whole numbers, in doubles only where no sum can leave
2^53. Vectors of one length share no bound that helps if they point everywhere: then each group gets nearly all of them,
``pivots`` rows a vector, whatever the number of rows.

Ties go to the smaller id. A query's own row (by id) is no candidate; with fewer than ``top`` others, all are returned. Vectors
that are null or empty or hold a null or non-finite component take no part, nor do those whose squared components sum up to
2^62 or more, since scores are 64-bit. Only vectors of the most frequent length are compared (of equally frequent lengths,
the larger). Rows without an id, and all but one of the rows that share an id and a vector, take no part. Copies of a vector
are dealt by id, so they fill no task. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmix.storage import stage

SCALE = 256
_LIMIT = float(2**62)  # of a squared length; inner products then fit 64 bits
_WIDER = 1e-6
RESULT = "query_id long, rank int, vec_id long, score long"


@dataclass(frozen=True)
class Settings:
    pivots: int = 16
    #: The pivots are fitted on the vectors with the least hashes of their ids, at most so many.
    sample: int = 20_000
    rounds: int = 5
    slice_rows: int = 16_384
    query_batch: int = 512


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.floor(F.when(F.abs(x) < F.lit(2.0**24), x).otherwise(2.0**24) * SCALE).cast("double")
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + scaled(x) * scaled(x))
    return F.coalesce((F.size(vector) > 0) & fine & (length < F.lit(_LIMIT)), F.lit(False))


def scaled_vectors(rows: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """``(id, v array<int>, q)``: the vectors that take part, each component x as floor(256 x)."""
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    held = held.where(F.col("id").isNotNull() & _usable(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))
    return held.select("id", whole.alias("v"), F.coalesce("q", F.lit(False)).alias("q")).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T).argmin(axis=1)


def _fitted(x: np.ndarray, settings: Settings) -> np.ndarray:
    """Pivots by k-means; a pivot without vectors keeps its place."""
    x = np.unique(x, axis=0)
    pivots = x[np.random.Generator(np.random.PCG64(11)).permutation(len(x))[: settings.pivots]]
    for _ in range(settings.rounds):
        near = _nearest(x, pivots)
        counts = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def thresholds(pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, query_radii: np.ndarray, enough: int) -> np.ndarray:
    """For each group of queries a score that ``enough`` vectors reach with any query of the group."""
    norms = np.sqrt((pivots**2).sum(axis=1))
    spread = query_radii[:, None] * norms[None] + norms[:, None] * radii[None] + query_radii[:, None] * radii[None]
    lowest = pivots @ pivots.T - spread * (1 + _WIDER)
    out = np.full(len(pivots), -np.inf)
    for i in range(len(pivots)):
        order = np.argsort(-lowest[i], kind="stable")
        held = np.cumsum(sizes[order])
        if held[-1] >= enough:
            out[i] = lowest[i][order[np.searchsorted(held, enough)]]
    return out


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(x).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return queries @ x.T


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> pa.RecordBatch:
    """The best ``top`` of the vectors for each query, ties by id; ``ids`` is sorted."""
    scores = products(queries, x)
    own = query_ids[:, None] == ids[None]
    found = []
    for k in range(len(query_ids)):
        allowed = np.flatnonzero(~own[k])
        row = scores[k][allowed]
        if len(row) > top:
            least = np.partition(row, len(row) - top)[len(row) - top]
            near = np.flatnonzero(row >= least)  # ties included
        else:
            near = np.arange(len(row))
        near = near[np.argsort(-row[near], kind="stable")][:top]  # ids ascend, so equal scores keep their order
        found.append((np.full(len(near), query_ids[k]), ids[allowed[near]], row[near]))
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def search(
    rows: DataFrame, is_query: Column, key: str, vector: str, top: int = 5, settings: Settings = Settings()
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``is_query``, the ``top`` largest integer inner products."""
    vectors = stage(scaled_vectors(rows, is_query, key, vector), "scaled")
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    width, total = common["n"], common["rows"]
    vectors = vectors.where(F.size("v") == width)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("v").toArrow()
    pivots = _fitted(_matrix(sample.column("v"), width).astype(float), settings)
    count = len(pivots)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            cell = _nearest(x, pivots)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["id", "v", "q", "cell", "far"])

    placed = stage(vectors.mapInArrow(assign, "id long, v array<int>, q boolean, cell int, far double"), "cells")
    sizes, radii, query_radii, asked = (np.zeros(count) for _ in range(4))
    asks = F.when(F.col("q"), F.col("far"))
    facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(asks).alias("asks"), F.count(asks).alias("queries"))
    for r in facts.collect():  # one per pivot
        sizes[r["cell"]], radii[r["cell"]], query_radii[r["cell"]], asked[r["cell"]] = r["n"], r["far"], r["asks"] or 0.0, r["queries"]
    # One more than asked for, since a query is no candidate of its own, for each row that may share its id.
    shared = placed.where("q").groupBy("id").count().agg(F.max("count")).first()[0] or 1
    limits = thresholds(pivots, sizes, radii, query_radii, top + shared)
    groups = np.flatnonzero(asked)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups that need each vector."""
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            reach = query_radii[groups][None] * np.sqrt((x**2).sum(axis=1))[:, None]
            middle = x @ pivots[groups].T
            needs = middle + reach + _WIDER * (np.abs(middle) + reach + 1) >= limits[groups][None]
            ends = np.concatenate([[0], np.cumsum(needs.sum(axis=1))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(groups[np.nonzero(needs)[1]], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "groups"])

    needed = placed.select("id", "v").mapInArrow(wanted, "id long, v array<int>, groups array<int>")
    slices = -(-total // settings.slice_rows)
    dealt = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    data = needed.select(F.explode("groups").alias("group"), dealt.alias("slice"), F.lit(False).alias("asks"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    queries = placed.where("q").select(F.col("cell").alias("group"), every.alias("slice"), F.lit(True).alias("asks"), "id", "v")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and slice, the vectors of each before its queries."""
        place, ids, held, done = None, [], [], None
        for batch in batches:
            places = batch.column("group").to_numpy().astype(np.int64) * slices + batch.column("slice").to_numpy()
            kinds = places * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            number, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if places[a] != place:
                    place, ids, held, done = places[a], [], [], None
                if not kinds[a] % 2:
                    ids.append(number[a:b])
                    held.append(x[a:b].astype(np.int32))
                    continue
                if not ids:
                    continue
                if done is None:
                    all_ids, all_x = np.concatenate(ids), np.concatenate(held)
                    order = np.argsort(all_ids, kind="stable")
                    done = all_ids[order], all_x[order].astype(np.int64)
                    ids, held = [done[0]], []
                for start in range(a, b, settings.query_batch):
                    part = slice(start, min(b, start + settings.query_batch))
                    yield _best(number[part], x[part], *done, top)

    spread = data.unionByName(queries).repartition("group", "slice").sortWithinPartitions("group", "slice", "asks")
    found = spread.mapInArrow(local, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
