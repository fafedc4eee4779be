"""Whole jobs from files to files, with the options of the command-line tools they stand in for.

``partition`` spreads the input over that many tasks; without it the input stays as it is read. Tables stored on the way are
deleted when a job ends, also by an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.functions.uniform import uniform
from logmix.plans.clustering import Model, assign, fit, posterior
from logmix.plans.counting import word_count
from logmix.plans.extraction import LOG_WIDTH, extract_text
from logmix.plans.growing import grow_index, recode
from logmix.plans.indexing import encode, index_features
from logmix.plans.logistic import components, start_weights, train_logistic
from logmix.sources import sinks
from logmix.sources.text import (
    LINE,
    checked_vectors,
    observe_widths,
    odd_widths,
    parse_vectors,
    read_labelled,
    read_lines,
    read_numbered_lines,
    read_spec,
    rejected,
    sound,
    split_tsv,
)
from logmix.storage import delete, exists, replace, scratch, stage


def _positive(**options: int | None) -> None:
    for name, value in options.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")


def run_extract(
    spark: SparkSession, input: str, output: str, partition: int | None = None, strict: bool = True
) -> dict[str, int]:
    """Ad-log lines to cleaned, TAB-joined text fields.

    A line of another width fails the job. Without ``strict`` it is written with what it has. Returned is how many lines
    have which wrong width (``cells_<n>`` for too few cells, ``wider`` for too many), counted while they are written.
    """
    _positive(partition=partition)
    lines, seen = observe_widths(read_lines(spark, input, partition), LOG_WIDTH)
    sinks.write_lines(extract_text(lines, strict=strict).select(F.col("line").alias("value")), output)
    return odd_widths(seen)


def run_index(
    spark: SparkSession,
    input: str,
    output: str,
    index: str,
    partition: int | None = None,
    max_cutoff: int | None = None,
    min_cutoff: int = 1,
    min_exclusive: bool = False,
    allow_empty: bool = False,
    **options,
) -> list[str]:
    """TSV lines and the field spec at ``index`` to ``data`` (ids), ``feature`` (values) and ``feature.dat`` (spec).

    Returns the names of the kept features. A raw field without any value fails the job unless ``allow_empty``.
    """
    _positive(partition=partition)
    with scratch(spark):
        spec = read_spec(spark, index)
        width = max((r["pos"] for r in spec.select("pos").collect()), default=-1) + 1  # one row per column
        raw = split_tsv(read_numbered_lines(spark, input, partition), [f"c{i}" for i in range(width)], LINE)
        result = index_features(
            raw, spec, min_cutoff, max_cutoff,
            min_exclusive=min_exclusive, keep=[LINE], row_id=LINE, allow_empty=allow_empty, **options,
        )
        sinks.write_vectors(result.encoded, result.columns, f"{output}/data")
        sinks.write_dictionary_text(result.dictionary, f"{output}/feature")
        sinks.write_kept(result.kept, f"{output}/feature.dat")
        return [r["name"] for r in result.kept.orderBy("feature_id").collect()]


def run_index_part(
    spark: SparkSession,
    input: str,
    output: str,
    index: str,
    part: str,
    partition: int | None = None,
    max_cutoff: int | None = None,
    min_cutoff: int = 1,
    min_exclusive: bool = False,
    allow_empty: bool = False,
    **options,
) -> list[str]:
    """``run_index`` for file sets that arrive one after the other: only the raw lines of ``input`` are read.

    ``output`` holds ``data/part=<part>`` (ids) for every part so far, ``feature`` and ``feature.dat`` as ``run_index`` writes them, and
    ``index`` (the values counted so far). Values of the new part are merged in, its lines encoded, and the ids of
    older parts brought up to date by their old ids. All of it takes the old output's place at once; a job that fails leaves
    that whole. A part that is there already is an error, and so is a feature that older parts were encoded without.
    """
    _positive(partition=partition)
    with scratch(spark):
        spec = read_spec(spark, index)
        width = max((r["pos"] for r in spec.select("pos").collect()), default=-1) + 1  # one row per column
        raw = split_tsv(read_numbered_lines(spark, input, partition), [f"c{i}" for i in range(width)], LINE)
        held = exists(spark, f"{output}/index/values")
        if held and exists(spark, f"{output}/data/part={part}"):
            raise ValueError(f"part {part} is there already")
        before = sinks.load_index(spark, f"{output}/index") if held else None
        after = grow_index(
            before, raw, spec, min_cutoff, max_cutoff, min_exclusive=min_exclusive, keep=[LINE], allow_empty=allow_empty
        )
        fields = after.kept.orderBy("feature_id").collect()  # one row per column
        columns = [f"f{r['feature_id']}" for r in fields]
        dictionary = stage(after.dictionary(), "dictionary", by=["feature_id"])
        rows = encode(raw, [f"c{r['pos']}" for r in fields], dictionary, LINE, row_id=LINE, **options)
        coded = rows.select(F.lit(part).alias("part"), *columns)
        if held:
            lines = spark.read.schema("value string, part string").text(f"{output}/data")
            old = parse_vectors(lines, before.kept.count(), "part")
            coded = coded.unionByName(recode(old, before, after, "part", **options))

        def write(folder: str) -> None:
            sinks.write_vector_parts(coded, columns, f"{folder}/data")
            sinks.write_dictionary_text(dictionary, f"{folder}/feature")
            sinks.write_kept(after.kept, f"{folder}/feature.dat")
            sinks.save_index(after, f"{folder}/index")

        replace(spark, output, write)
        return [r["name"] for r in fields]


def run_cluster(
    spark: SparkSession,
    input: str,
    output: str,
    cluster: int,
    feature: int,
    iteration: int = 50,
    partition: int | None = None,
    sample: int = 0,
    alpha: float = -1.0,
    seed: int = 0,
    beta: float | None = None,
    prior: str = "cells",
    collapse: bool = True,
    tasks: int | None = None,
    how: str = "sampled",
    trace: bool = False,
    resume: bool = False,
    strict: bool = True,
) -> Model:
    """Id lines to ``data`` (each line with its score) and ``model``, and with ``trace`` every iteration to ``trace``.

    The tables ``statistics``, ``theta`` and ``prior`` in ``trace`` grow by a partition ``iter=<i>`` as each iteration ends. With
    ``resume``, a job that was stopped goes on after the last whole one; without it, an old trace is deleted first.

    A line with a cell that is no 32-bit whole number fails the job. Without ``strict`` such lines are set apart by the pass
    that reads, written to ``rejected`` with what is wrong with them, and the fit and the scores go over the others.

    ``sample`` only chooses the kind of fit: 0 or less is soft, more is hard. ``how`` is the score: a cluster drawn from
    the posterior ("sampled"), the likeliest ("argmax") or the probabilities ("posterior"). The model returned is the
    written one.
    """
    _positive(cluster=cluster, iteration=iteration, feature=feature, partition=partition, tasks=tasks)
    if how not in ("sampled", "argmax", "posterior"):
        raise ValueError("how is 'sampled', 'argmax' or 'posterior'")
    with scratch(spark):
        state = f"{output}/trace" if trace or resume else None
        if state and not resume:
            delete(spark, state)
        lines = read_numbered_lines(spark, input, partition)
        if strict:
            rows = stage(parse_vectors(lines, feature, LINE), "vectors")
        else:
            checked = stage(checked_vectors(lines, feature, LINE), "vectors")
            sinks.write_rejected(rejected(checked), f"{output}/rejected")
            rows = sound(checked)
        columns = [f"f{d}" for d in range(feature)]
        model = fit(
            rows, columns, cluster, iteration, mode="soft" if sample <= 0 else "hard", prior=prior, alpha=alpha, beta=beta,
            seed=seed, collapse=collapse, stored=True, tasks=tasks, state=state,
        )
        if how == "posterior":
            scored = posterior(rows, columns, model, "cluster")
        else:
            scored = assign(rows, columns, model, how=how, u=uniform(seed, F.col(LINE)) if how == "sampled" else None)
        sinks.write_scores(scored, columns, "cluster", f"{output}/data")
        sinks.save_model(model, f"{output}/model")
    return sinks.load_model(spark, f"{output}/model")


def run_word_count(spark: SparkSession, input: str, partition: int | None = None) -> DataFrame:
    _positive(partition=partition)
    return word_count(read_lines(spark, input, partition))


def run_logistic_regression(spark: SparkSession, input: str, iterations: int, dimensions: int = 16) -> list[float]:
    points = read_labelled(spark, input, dimensions)
    x = components(points, "x", dimensions)
    return train_logistic(points, F.col("y"), x, iterations, weights=start_weights(dimensions))
