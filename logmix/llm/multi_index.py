"""Nearest neighbours with an inverted multi-index.

A vector is cut into two halves, each quantised with its own codebook; a pair of centroids is a cell. For a query, a heap
yields the filled cells by the sum of both halves' distances until they hold enough vectors. The cells passed on the way are
just those whose sum is at most the last one's, so a query travels as its vector and that one number, and the tasks that
hold the vectors pick the same cells again. The candidates are ranked by their distance on the original vectors.

* The codebooks are fitted on the driver, on at most ``sample`` vectors (those with the least hashes of their ids).
* Every vector is indexed. Vectors are dealt by a hash of their id, not by cell, so a vector that a third of the rows repeat
  does not fill one task; queries meet them block by block, and a block sends its best few per query.
* The driver sees the number of vectors in each cell (at most ``codes`` squared) and the codebooks.

A query's own row (by id) is no candidate. Vectors that are null, zero or hold a null or non-finite component take no part,
nor do those whose length is not the most frequent one (of equally frequent lengths, the larger). Rows without an id, and
all but one of the rows that share an id and a vector, take no part either. Fewer candidates than asked for are all
returned. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmix.storage import stage


@dataclass(frozen=True)
class Settings:
    codes: int = 256  # centroids of each half
    sample: int = 20_000  # vectors that the codebooks are fitted on, at most
    rounds: int = 10
    #: A query visits cells until they hold this share of all vectors, and at least ``least``.
    share: float = 0.35
    least: int = 1000
    block: int = 4096  # vectors of a block
    query_block: int = 256


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None] - 2 * x @ centers.T).argmin(axis=1)


def _codebook(x: np.ndarray, codes: int, rounds: int) -> np.ndarray:
    """k-means; an empty cluster keeps its center."""
    distinct = np.unique(x, axis=0)
    pick = np.random.Generator(np.random.PCG64(5)).permutation(len(distinct))[:codes]
    centers = distinct[pick]
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _halves(query: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cut = len(query) // 2
    return tuple(((b - q) ** 2).sum(axis=1) for b, q in zip(books, (query[:cut], query[cut:]), strict=True))


def _reach(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], filled: np.ndarray, enough: int) -> float:
    """The sum at which the cells, taken from a heap by their sums, first hold ``enough`` vectors."""
    first, second = _halves(query, books)
    order = np.argsort(second, kind="stable")
    rows = [order[filled[i][order] > 0] for i in range(len(first))]
    heap = [(first[i] + second[r[0]], i, 0) for i, r in enumerate(rows) if len(r)]
    heapq.heapify(heap)
    held, last = 0, 0.0
    while heap and held < enough:
        last, i, k = heap[0]
        held += filled[i, rows[i][k]]
        if k + 1 < len(rows[i]):
            heapq.heapreplace(heap, (first[i] + second[rows[i][k + 1]], i, k + 1))
        else:
            heapq.heappop(heap)
    return last


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    rows: DataFrame, is_query: Column, key: str, vector: str, top: int = 10, settings: Settings = Settings()
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``is_query``, the ``top`` nearest others found."""
    vectors = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    vectors = vectors.where(F.col("id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["id", "v"])
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    dimension, total = common["n"], common["rows"]
    vectors = vectors.where(F.size("v") == dimension)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("v").toArrow()
    points = _matrix(sample.column("v").combine_chunks(), dimension)
    cut = dimension // 2
    books = tuple(_codebook(x, settings.codes, settings.rounds) for x in (points[:, :cut], points[:, cut:]))
    width = len(books[1])

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dimension)
            cell = _nearest(x[:, :cut], books[0]) * width + _nearest(x[:, cut:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["id", "v", "q", "cell"])

    indexed = stage(vectors.mapInArrow(assign, "id long, v array<double>, q boolean, cell long"), "indexed")
    filled = np.zeros(len(books[0]) * width, np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # bounded by the codebooks
        filled[r["cell"]] = r["n"]
    filled = filled.reshape(-1, width)
    enough = max(settings.least, int(settings.share * total), top + 1)
    asked = indexed.where("q").select("id", "v")

    def reach(batches):
        for batch in batches:
            far = [_reach(q, books, filled, enough) for q in _matrix(batch.column("v"), dimension)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.float64())], ["id", "v", "reach"])

    queries = stage(asked.mapInArrow(reach, "id long, v array<double>, reach double"), "queries")
    blocks = -(-total // settings.block)
    query_blocks = max(1, -(-queries.count() // settings.query_block))
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = indexed.select("id", "v", "cell", F.lit(None).cast("double").alias("reach"), place(blocks, 1).alias("i"), every(query_blocks).alias("j"))
    right = queries.select("id", "v", F.lit(None).cast("long").alias("cell"), "reach", every(blocks).alias("i"), place(query_blocks, 2).alias("j"))

    def best(part: pa.Table) -> pa.Table:
        asks = np.asarray(part.column("reach").is_valid())
        ids = part.column("id").to_numpy()
        x = _matrix(part.column("v").combine_chunks(), dimension)
        own, cells = np.flatnonzero(~asks), part.column("cell").to_numpy()[~asks].astype(np.int64)
        a, b = cells // width, cells % width
        out = []
        for k in np.flatnonzero(asks):
            first, second = _halves(x[k], books)
            near = own[(first[a] + second[b] <= part.column("reach")[int(k)].as_py()) & (ids[own] != ids[k])]
            distance = np.sqrt(((x[near] - x[k]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], distance))[:top]
            out.append((np.full(len(order), ids[k]), ids[near][order], distance[order]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = left.unionByName(right).groupBy("i", "j").applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
