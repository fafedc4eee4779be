"""The steps of expectation-maximisation for a mixture of categorical distributions, as DataFrame operators.

Tables: domain ``(feature_id, value_id, cnt, patterns)``, statistics ``(feature_id, value_id, k, n)``, theta
``(feature_id, value_id, k, p)``. Each data row may stand for ``w`` identical ones. Features are broadcast as far as
they fit the budget for the model; the others are joined to the data, so a model may be of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.functions.uniform import uniform
from logmix.operators import kernel
from logmix.operators.cells import to_cells
from logmix.operators.kernel import RECORD_MASS, LogModel, partial_statistics, scores, summed_statistics
from logmix.operators.lookup import Keyed, lookup, split_budget
from logmix.storage import Bucketed, stage, write_buckets

# The batch arithmetic travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(kernel)

WEIGHT = "w"
# Every Python worker holds its own copy of a broadcast model.
MODEL_BYTES = 128 * 1024 * 1024
STATISTICS = "feature_id int, value_id int, n array<double>"
# Partial sums of more tasks than this are added up in groups of so many first.
GROUP_TASKS = 1000


def with_clusters(domain: DataFrame, clusters: int) -> DataFrame:
    """One row per (feature, value, cluster)."""
    every_k = F.explode(F.sequence(F.lit(0), F.lit(clusters - 1)))
    return domain.select("feature_id", "value_id", every_k.alias("k"))


def normalize_theta(raw: DataFrame) -> DataFrame:
    """Scale column ``x`` of ``(feature_id, value_id, k, x)`` to sum to 1 over the values of each feature and cluster.

    ``raw`` is read twice, so it should be cheap or stored. Sums use partial aggregation rather than a window, whose
    group would be a whole feature; there is one per feature and cluster, so they are broadcast.
    """
    totals = raw.groupBy("feature_id", "k").agg(F.sum("x").alias("total"))
    return raw.join(F.broadcast(totals), ["feature_id", "k"]).select(
        "feature_id", "value_id", "k", (F.col("x") / F.col("total")).alias("p")
    )


def random_theta(domain: DataFrame, clusters: int, seed: int) -> DataFrame:
    """Uniform random distributions, repeatable for a seed whatever the partitioning."""
    u = uniform(seed, F.col("feature_id"), F.col("value_id"), F.col("k"))
    return normalize_theta(with_clusters(domain, clusters).withColumn("x", u))


def random_prior(clusters: int, seed: int) -> list[float]:
    """Made from the same hash as the distributions."""
    digits = [hashlib.md5(f"{seed},prior,{k}".encode()).hexdigest()[:12] for k in range(clusters)]
    u = [int(x, 16) for x in digits]
    return [x / sum(u) for x in u]


def uniform_theta(domain: DataFrame, clusters: int) -> DataFrame:
    """p = 1/V for each of the V values of a feature."""
    sizes = domain.groupBy("feature_id").agg(F.count("*").alias("v_size"))
    return with_clusters(domain, clusters).join(F.broadcast(sizes), "feature_id").select(  # one row per feature
        "feature_id", "value_id", "k", (F.lit(1.0) / F.col("v_size")).alias("p")
    )


def prior_table(spark: SparkSession, prior: Sequence[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, prior))), "k int, p double")


def domain_sizes(domain: DataFrame) -> dict[int, int]:
    """V for each feature."""
    return {r["feature_id"]: r["v"] for r in domain.groupBy("feature_id").agg(F.count("*").alias("v")).collect()}


def broadcast_features(sizes: dict[int, int], clusters: int, budget: int = MODEL_BYTES) -> set[int]:
    """The features whose part of the model is broadcast: smallest first, within ``budget`` bytes."""
    return split_budget({d: 8 * v * clusters for d, v in sizes.items()}, budget)


def collect_log_model(
    theta: DataFrame, prior: Sequence[float], features: int, broadcast: set[int], hot: Sequence[tuple[int, int]] = ()
) -> LogModel:
    """The prior, the ``broadcast`` features, whose size was checked, and the few ``hot`` (feature, value) pairs of others, as
    arrays on the driver."""
    clusters = len(prior)
    wanted = F.col("feature_id").isin(sorted(broadcast))
    for d in sorted({d for d, _ in hot}):
        wanted = wanted | (F.col("feature_id") == d) & F.col("value_id").isin(sorted(v for e, v in hot if e == d))
    rows = theta.where(wanted).select("feature_id", "value_id", "k", "p").toArrow()
    feature, value, k, p = (rows.column(i).to_numpy() for i in range(4))
    by_value = np.lexsort((k, value, feature)).reshape(-1, clusters)
    with np.errstate(divide="ignore"):
        log_theta = np.vstack([np.log(p[by_value]), np.zeros((1, clusters))])
        log_prior = np.log(np.asarray(prior, float))
    feature, value = feature[by_value[:, 0]], value[by_value[:, 0]].astype(np.int64)
    first = np.searchsorted(feature, np.arange(features + 1))
    value_ids = [value[first[d] : first[d + 1]] for d in range(features)]
    return LogModel(log_theta, log_prior, value_ids, first[:-1].tolist(), [d for d in range(features) if d not in broadcast])


def _log_lists(theta: DataFrame, joined: Sequence[int]) -> DataFrame:
    """``(feature_id, value_id, log_p array)`` of the joined features."""
    by_value = theta.where(F.col("feature_id").isin(list(joined))).groupBy("feature_id", "value_id")
    listed = by_value.agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("by_k"))  # K entries
    return listed.select("feature_id", "value_id", F.transform("by_k", lambda e: F.ln(e["p"])).alias("log_p"))


def _checked(found: Column) -> Column:
    odd = F.concat(F.lit("value id "), F.col("value_id").cast("string"), F.lit(" of feature "), F.col("feature_id").cast("string"))
    return F.when(found.isNull(), F.raise_error(F.concat(odd, F.lit(" is not in the model")))).otherwise(found)


def join_logs(
    rows: DataFrame, columns: Sequence[str], theta: DataFrame, counts: DataFrame, joined: Sequence[int], row_id: str
) -> DataFrame:
    """Add ``_logs``, the lists of ln p by cluster of the cells of all features in ``joined``; other rows have no column.

    ``counts (feature_id, value_id, cnt)`` tells how often a value occurs in ``rows``, which is stored, and ``row_id`` names a
    number of each row. All cells go through one join on (feature, value), with hot pairs broadcast, and the lists go back to
    their rows. A value that theta does not have is an error.
    """
    if not joined:
        return rows
    known = counts.where(F.col("feature_id").isin(list(joined))).select("feature_id", "value_id", "cnt")
    pair = F.struct("feature_id", "value_id").alias("_pair")
    logs = _log_lists(theta, joined).join(known, ["feature_id", "value_id"], "left")
    logs = stage(logs.select(pair, "log_p", F.coalesce("cnt", F.lit(0)).alias("cnt")), "log-theta")
    filled = known.agg(F.sum("cnt")).first()[0] or 0
    cells = to_cells(rows, [columns[d] for d in joined], joined, row_id).withColumnRenamed("value", "value_id")
    found = lookup(cells.select("*", pair), "_pair", Keyed(logs, "_pair", "log_p", filled), "_found", False, F.col(row_id))
    lists = found.groupBy(row_id).agg(F.collect_list(_checked(F.col("_found"))).alias("_logs"))
    return rows.join(lists, row_id, "left")


@dataclass(frozen=True)
class CoPartitioned:
    """Data rows laid out for a model that is joined to them.

    ``rows`` are in buckets by their number, and ``cells (_row, feature_id, value_id)`` of the joined features in buckets by
    (feature, value), as is each iteration's model. So an iteration moves no cells to the model and no rows to their sums: only
    what the cells found goes from one to the other. Hot pairs have no cells: their part of the model is broadcast.
    """

    rows: Bucketed
    cells: Bucketed
    joined: list[int]
    hot: list[tuple[int, int]]

    def with_logs(self, theta: DataFrame, scratch: list | None) -> DataFrame:
        """The rows with ``_logs``, lists of ln p by cluster. The buckets of the model are added to ``scratch``."""
        logs = write_buckets(_log_lists(theta, self.joined), ["feature_id", "value_id"], "log-theta")
        if scratch is not None:
            scratch.append(logs)
        cells = self.cells.table().join(logs.table().hint("shuffle_hash"), ["feature_id", "value_id"], "left")
        lists = cells.groupBy("_row").agg(F.collect_list(_checked(F.col("log_p"))).alias("_logs"))
        # The lists are as many as the rows: neither side is one to broadcast or to hold in memory.
        return self.rows.table().join(lists.hint("merge"), "_row", "left")

    def drop(self) -> None:
        self.rows.drop()
        self.cells.drop()


def co_partition(patterns: DataFrame, columns: Sequence[str], domain: DataFrame, joined: Sequence[int]) -> CoPartitioned:
    """Write ``patterns`` and the cells of the features ``joined`` in buckets, as many as there are shuffle partitions."""
    partitions = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = domain.where(F.col("feature_id").isin(list(joined))).select("feature_id", "value_id", "patterns")
    filled = own.agg(F.sum("patterns")).first()[0] or 0
    # A pair is hot if it fills the mean bucket; there can be no more such pairs than buckets.
    hot = [(r["feature_id"], r["value_id"]) for r in own.where(F.col("patterns") * partitions >= filled).collect()]
    rows = write_buckets(patterns.withColumn("_row", F.monotonically_increasing_id()), ["_row"], "rows")
    cells = to_cells(rows.table(), [columns[d] for d in joined], joined, "_row").withColumnRenamed("value", "value_id")
    for d in sorted({d for d, _ in hot}):
        cells = cells.where((F.col("feature_id") != d) | ~F.col("value_id").isin([v for e, v in hot if e == d]))
    return CoPartitioned(rows, write_buckets(cells, ["feature_id", "value_id"], "cells"), list(joined), hot)


def partial_sums(
    rows: DataFrame, columns: Sequence[str], model: LogModel, hard: bool, scratch: list | None = None
) -> DataFrame:
    """Partial statistics ``(feature_id, value_id, n array)`` from each task, to be summed.

    The broadcast model is added to ``scratch``, for a caller that knows when it is no longer read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.arrays())
    if scratch is not None:
        scratch.append(shared)

    def run(batches):
        return partial_statistics(LogModel(*shared.value), batches, hard)

    logs = ["_logs"] if model.joined else []
    return rows.select(*columns, *logs, F.col(WEIGHT).cast("double")).mapInArrow(run, STATISTICS)


def score(rows: DataFrame, columns: Sequence[str], model: LogModel, kind: str, u: str | None) -> Column:
    """The posterior ("soft"), the likeliest cluster ("argmax") or a draw by column ``u`` ("sampled")."""
    shared = rows.sparkSession.sparkContext.broadcast(model.arrays())

    def run(*cells: pa.Array) -> pa.Array:
        return scores(LogModel(*shared.value), list(cells), kind)

    logs = ["_logs"] if model.joined else []
    inputs = [*columns, *logs, *([u] if kind == "sampled" else [])]
    return F.arrow_udf(run, "array<double>" if kind == "soft" else "int")(*[F.col(c) for c in inputs])


def sum_statistics(partial: DataFrame, domain: DataFrame, clusters: int, tasks: int = 1) -> DataFrame:
    """Add up partial statistics to ``(feature_id, value_id, k, n)``, with zeros where nothing fell on a value.

    A hot value comes as one array from each of ``tasks``. If these are many, they are summed in groups first, so that a value
    meets some thousand arrays at most, in a group and then from all groups. Shuffling whole arrays moves a fraction of the
    bytes and rows that one row per cluster would.
    """
    zeros = domain.select("feature_id", "value_id", F.array_repeat(F.lit(0.0), clusters).alias("n"))

    def run(batches):
        return summed_statistics(batches, clusters)

    if tasks > GROUP_TASKS:
        groups = -(-tasks // GROUP_TASKS)
        # Tasks that stand for the same rows get the same group again when they are retried.
        dealt = partial.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition("_group", "feature_id", "value_id")
        ordered = dealt.sortWithinPartitions("_group", "feature_id", "value_id").select("feature_id", "value_id", "n")
        partial = ordered.mapInArrow(run, STATISTICS)
    dealt = partial.unionByName(zeros).repartition("feature_id", "value_id")
    summed = dealt.sortWithinPartitions("feature_id", "value_id").mapInArrow(run, STATISTICS)
    return summed.select("feature_id", "value_id", F.posexplode("n").alias("k", "n"))


def cluster_mass(statistics: DataFrame, per: str) -> DataFrame:
    """``(k, mass)``: each cluster's share of all present cells (``per="cells"``) or of all rows (``"records"``)."""
    wanted = F.col("feature_id") >= 0 if per == "cells" else F.col("feature_id") == RECORD_MASS
    return statistics.where(wanted).groupBy("k").agg(F.sum("n").alias("mass"))


def update_theta(statistics: DataFrame, sizes: dict[int, int], beta: float | None = None) -> DataFrame:
    """theta = (beta + n), scaled per feature and cluster. ``beta`` is 1/V by default."""
    pseudo = [(d, 1.0 / v if beta is None else float(beta)) for d, v in sizes.items()]  # one row per feature
    betas = statistics.sparkSession.createDataFrame(pseudo, "feature_id int, beta double")
    raised = statistics.join(F.broadcast(betas), "feature_id").withColumn("x", F.col("n") + F.col("beta"))
    return normalize_theta(raised)


def update_prior(mass: Sequence[float], alpha: float) -> list[float]:
    raised = np.asarray(mass, float) + alpha
    return (raised / raised.sum()).tolist()
