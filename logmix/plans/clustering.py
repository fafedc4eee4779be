"""Fitting a mixture of categorical distributions to integer-coded rows, and scoring rows with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmix.functions.uniform import uniform
from logmix.operators import mixture as mx
from logmix.operators.cells import encoded_value_counts, to_cells
from logmix.plans.fit_state import FitState
from logmix.storage import drop_table, new_folder, stage

Start = tuple[DataFrame, Sequence[float]]
# Each task of a pass sends sums of up to the whole broadcast model. Input splits are merged only where these sums would be
# more than one for so many cells read.
_CELLS_PER_SUM = 4


@dataclass
class Model:
    """theta ``(feature_id, value_id, k, p)``, the cluster prior, and the domain with its counts.

    ``state`` holds the statistics, theta and prior of every iteration if the fit was asked to keep them.
    """

    theta: DataFrame
    prior: list[float]
    domain: DataFrame
    state: FitState | None = None

    @property
    def clusters(self) -> int:
        return len(self.prior)

    @property
    def trace(self) -> list[tuple[DataFrame, DataFrame, list[float]]]:
        """``(statistics, theta, prior)`` of each iteration that was kept."""
        return [self.state.read(i) for i in range(1, self.state.last() + 1)] if self.state else []

    def prior_table(self) -> DataFrame:
        return mx.prior_table(self.theta.sparkSession, self.prior)


def distinct_patterns(
    encoded: DataFrame, columns: Sequence[str], collapse: bool = True, stored: bool = False, tasks: int | None = None
) -> DataFrame:
    """Feature columns and a weight ``w``, stored once for all iterations; in ``tasks`` files, if that is given.

    If ``encoded`` is a ``stored`` table already and its rows are not collapsed, it is used where it is, unless ``tasks`` asks
    for more splits than it has.

    Identical rows share one posterior, so ``collapse`` keeps one with its count, which is exact. Where rows are mostly
    unique the grouping only shuffles the whole table, so it may be switched off.
    """
    features = encoded.select(*[F.when(F.col(c) >= 0, F.col(c)).cast("int").alias(c) for c in columns])
    if collapse:
        rows = features.groupBy(*columns).agg(F.count("*").alias(mx.WEIGHT))
    else:
        rows = features.withColumn(mx.WEIGHT, F.lit(1).cast("bigint"))
        if used_in_place(encoded, collapse, stored, tasks):
            return rows
    return stage(rows.repartition(tasks) if tasks else rows, "patterns")


def used_in_place(encoded: DataFrame, collapse: bool, stored: bool, tasks: int | None) -> bool:
    """Whether a fit reads its input where it is, rather than a table of its own."""
    return stored and not collapse and (tasks is None or encoded.rdd.getNumPartitions() >= tasks)


def data_domain(patterns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature_id, value_id, cnt, patterns)`` of the values that occur."""
    return encoded_value_counts(patterns, columns, mx.WEIGHT)


def estep_statistics(
    patterns: DataFrame,
    columns: Sequence[str],
    theta: DataFrame,
    prior: Sequence[float],
    domain: DataFrame,
    hard: bool = False,
    broadcast: set[int] | None = None,
    scratch: list | None = None,
    layout: mx.CoPartitioned | None = None,
    tasks: int = 1,
) -> DataFrame:
    """Expected (soft) or assigned (hard) cluster mass of every (feature, value).

    ``patterns`` is a stored table. ``broadcast`` are the features to broadcast, by default those that fit the budget; the
    others are joined to the rows in their ``layout``, which is made here if it is not given. What only this step reads is
    added to ``scratch``. ``tasks`` is the number of splits of ``patterns``.
    """
    if broadcast is None:
        broadcast = mx.broadcast_features(mx.domain_sizes(domain), len(prior))
    joined = [d for d in range(len(columns)) if d not in broadcast]
    if joined and layout is None:
        layout = mx.co_partition(patterns, columns, domain, joined)
    model = mx.collect_log_model(theta, prior, len(columns), broadcast, layout.hot if layout else ())
    rows = layout.with_logs(theta, scratch) if layout else patterns
    return mx.sum_statistics(mx.partial_sums(rows, columns, model, hard, scratch), domain, len(prior), tasks)


def _release(scratch: list) -> None:
    for thing in scratch:
        if isinstance(thing, DataFrame):
            drop_table(thing)
        else:
            thing.drop() if hasattr(thing, "drop") else thing.destroy()
    scratch.clear()


def _merged(table: DataFrame, tasks: int | None, sizes: dict[int, int], broadcast: set[int], cells: int) -> tuple[DataFrame, int]:
    """The table in the splits of a pass, and their number."""
    splits = table.rdd.getNumPartitions()
    sums = sum(v for d, v in sizes.items() if d in broadcast)
    most = tasks or max(table.sparkSession.sparkContext.defaultParallelism, cells // max(1, _CELLS_PER_SUM * sums))
    return (table.coalesce(most), most) if splits > most else (table, splits)


def fit(
    encoded: DataFrame,
    columns: Sequence[str],
    clusters: int,
    iterations: int = 50,
    *,
    mode: str = "soft",
    prior: str = "cells",
    alpha: float = -1.0,
    beta: float | None = None,
    seed: int = 0,
    start: Start | Callable[[DataFrame], Start] | None = None,
    collapse: bool = True,
    stored: bool = False,
    tasks: int | None = None,
    keep_trace: bool = False,
    state: str | None = None,
    model_bytes: int = mx.MODEL_BYTES,
) -> Model:
    """Expectation-maximisation for a fixed number of iterations.

    ``mode`` is "soft" or "hard" (each row counts for its likeliest cluster). ``prior`` weighs clusters by present
    cells ("cells") or by rows ("records"). ``alpha <= 0`` means 1/K, and no ``beta`` means 1/V for each feature.
    ``start`` is a first ``(theta, prior)``, or a function that makes one for the domain; by default a random one.
    ``stored`` tells that ``encoded`` is a written table, ``collapse`` makes one row of identical ones. Passes keep the input
    splits, unless their sums would outgrow what is read; ``tasks`` spreads or merges them to that number. Up to ``model_bytes``
    of the model are broadcast, the features with the smallest domains first; the other features are joined to the data.

    Statistics, theta and prior of an iteration are written when it ends. Those that are replaced are deleted, unless the fit is
    to ``keep_trace``, or ``state`` names a folder for them: a fit that finds its own state there goes on after the last whole
    iteration, with the same result as one that was not stopped. State of other data or options is an error.
    """
    if clusters <= 0 or iterations <= 0 or not columns:
        raise ValueError("clusters, iterations and the number of features must be positive")
    if mode not in ("soft", "hard") or prior not in ("cells", "records"):
        raise ValueError("mode is 'soft' or 'hard'; prior is 'cells' or 'records'")
    spark = encoded.sparkSession
    table = distinct_patterns(encoded, columns, collapse, stored, tasks)
    scratch: list = [] if used_in_place(encoded, collapse, stored, tasks) else [table]
    passing: list = []
    layout = None
    try:
        domain = stage(data_domain(table, columns), "domain")
        facts = domain.groupBy("feature_id").agg(F.count("*").alias("v"), F.sum("patterns").alias("cells")).collect()
        sizes, cells = {r["feature_id"]: r["v"] for r in facts}, sum(r["cells"] for r in facts)
        broadcast = mx.broadcast_features(sizes, clusters, model_bytes)
        joined = [d for d in range(len(columns)) if d not in broadcast]
        patterns, splits = _merged(table, tasks, sizes, broadcast, cells)
        pseudo = alpha if alpha > 0 else 1.0 / clusters
        log = FitState(spark, state or new_folder(spark, "fit")) if keep_trace or state else None
        if log:
            log.begin(
                domain,
                columns=list(columns), clusters=clusters, mode=mode, prior=prior, alpha=pseudo, beta=beta,
                seed=None if start is not None else seed,
            )
        done = min(log.last(), iterations) if log else 0
        if done:
            _, theta, weights = log.read(done)
        elif start is None:
            theta, weights = mx.random_theta(domain, clusters, seed), mx.random_prior(clusters, seed)
        else:
            theta, weights = start(domain) if callable(start) else start
        if joined and done < iterations:
            layout = mx.co_partition(table, columns, domain, joined)
            if not done:
                theta = stage(theta, "theta")
                passing.append(theta)
        for i in range(done + 1, iterations + 1):
            step = estep_statistics(
                patterns, columns, theta, weights, domain, mode == "hard", broadcast, passing, layout, splits
            )
            statistics = log.write_statistics(i, step) if log else stage(step, "statistics")
            _release(passing)
            mass = {r["k"]: r["mass"] for r in mx.cluster_mass(statistics, prior).collect()}  # K rows
            weights = mx.update_prior([mass.get(k, 0.0) for k in range(clusters)], pseudo)
            theta = mx.update_theta(statistics, sizes, beta)
            if log:
                theta = log.finish(i, theta, weights)
                continue
            passing.append(statistics)
            if joined and i < iterations:
                theta = stage(theta, "theta")
                passing.append(theta)
        if not log:
            theta = stage(theta, "theta")
    finally:
        _release(passing)
        _release(scratch)
        if layout:
            layout.drop()
    return Model(theta, weights, domain, log)


def posterior(
    rows: DataFrame, columns: Sequence[str], model: Model, out: str = "p", model_bytes: int = mx.MODEL_BYTES
) -> DataFrame:
    """Add the cluster probabilities of each row as an array."""
    return _score(rows, columns, model, out, "soft", None, model_bytes)


def assign(
    rows: DataFrame,
    columns: Sequence[str],
    model: Model,
    out: str = "cluster",
    *,
    how: str = "sampled",
    u: Column | None = None,
    keys: Sequence[str] = (),
    seed: int = 0,
    model_bytes: int = mx.MODEL_BYTES,
) -> DataFrame:
    """Add one cluster per row: the likeliest ("argmax"), or one drawn from the posterior ("sampled").

    A draw uses ``u`` if given, else a uniform number made from ``seed`` and the row's ``keys``, so the same row gets
    the same cluster on every run.
    """
    if how not in ("argmax", "sampled"):
        raise ValueError("how is 'argmax' or 'sampled'")
    if how == "sampled" and u is None:
        if not keys:
            raise ValueError("sampling needs a column u or the key columns of a row")
        u = uniform(seed, *[F.col(c) for c in keys])
    return _score(rows, columns, model, out, how, u, model_bytes)


def _score(rows, columns, model, out, kind, u, budget) -> DataFrame:
    broadcast = mx.broadcast_features(mx.domain_sizes(model.domain), model.clusters, budget)
    arrays = mx.collect_log_model(model.theta, model.prior, len(columns), broadcast)
    coded = [f"_cell{d}" for d in range(len(columns))]
    cells = [F.when(F.col(c) >= 0, F.col(c)).cast("int").alias(name) for c, name in zip(columns, coded)]
    held = rows.select("*", *cells, *([u.cast("double").alias("_u")] if u is not None else []))
    if arrays.joined:
        # Stored with a number, so that retried tasks agree; the counts are those of the rows to be scored.
        held = stage(held.withColumn("_row", F.monotonically_increasing_id()), "cells")
        own = to_cells(held, [coded[d] for d in arrays.joined], arrays.joined)
        counts = own.groupBy("feature_id", F.col("value").alias("value_id")).agg(F.count("*").alias("cnt"))
        held = mx.join_logs(held, coded, model.theta, counts, arrays.joined, "_row")
    scored = held.withColumn(out, mx.score(held, coded, arrays, kind, "_u"))
    return scored.select(*[c for c in rows.columns if c != out], out)
