"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.functions import text as tx
from logmix.functions.vectors import add_vectors, vector_line
from logmix.operators import cells
from logmix.operators import mixture as mx
from logmix.operators.ranking import rank_ordered
from logmix.plans import clustering as cl
from logmix.plans import counting, logistic
from logmix.plans.extraction import extract_text
from logmix.plans.growing import GrowingIndex, grow_index, recode
from logmix.plans.indexing import encode, kept_fields, project_features
from logmix.sources import sinks
from logmix.sources.text import (
    checked_labelled,
    checked_vectors,
    observe_widths,
    parse_labelled,
    parse_spec,
    parse_vectors,
    raw_fields,
    row_width_audit,
    split_tsv,
)
from logmix.storage import new_folder, stage
from workload import tables as t
from workload.tables import CLUSTERS, MAX_VALUES, MIN_VALUES, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(column: str | Column) -> Column:
    """Rounded, with no negative zero."""
    return F.round(column, DIGITS) + F.lit(0.0)


# --- sources and field specs ---


@query
def field_spec_filter(spark, sf_dir):
    flag = F.when(F.col("p_size") > 25, "1").otherwise("0")
    lines = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.concat_ws(" ", F.concat(F.lit("part_"), "p_partkey"), flag, "p_type").alias("value"),
    )
    return raw_fields(parse_spec(lines)).select("pos", "name", "family")


@query
def project_tsv_features(spark, sf_dir):
    """Orders as TSV lines, cut into columns, of which the raw ones are kept."""
    line = F.concat_ws(
        "\t", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string"), F.nullif("o_orderpriority", F.lit("1-URGENT"))
    )
    lines = read(spark, sf_dir, "orders").select(line.alias("value"))
    raw = split_tsv(lines, ["o_orderkey", "status", "price", "priority"])
    fields = t.spec(spark, "status 0 state", "price 1 money", "priority 0 state")
    return project_features(raw, fields, "o_orderkey")[0]


@query
def row_width_audit_lines(spark, sf_dir):
    lines = t.document_lines(spark, sf_dir).select(F.translate("value", " ", "\t").alias("value"))
    return row_width_audit(lines, 8)


@query
def row_widths_observed(spark, sf_dir):
    """Document lines as TSV, written; the wrong widths are counted by the pass that writes."""
    lines = t.document_lines(spark, sf_dir).select(F.translate("value", " ", "\t").alias("value"))
    watched, seen = observe_widths(lines, 8)
    sinks.write_lines(watched, new_folder(spark, "observed"))
    return spark.createDataFrame(sorted(seen.get.items()), "width string, lines long")


# --- counting, cut-offs, dictionaries ---


def _counts(spark, sf_dir) -> DataFrame:
    raw = t.lineitem_raw(spark, sf_dir)
    return cells.value_counts(raw, raw.columns, range(len(raw.columns)))


@query
def feature_value_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def feature_cardinality(spark, sf_dir):
    return cells.cardinality(_counts(spark, sf_dir))


@query
def max_cardinality(spark, sf_dir):
    return cells.largest_domain(cells.cardinality(_counts(spark, sf_dir)))


@query
def approx_feature_cardinality(spark, sf_dir):
    raw = t.lineitem_raw(spark, sf_dir)
    approx = cells.approx_cardinality(raw.drop("empty"), [c for c in raw.columns if c != "empty"])
    names = spark.createDataFrame([(i, p) for i, p in enumerate([0, 1, 2, 3, 4, 5, 7])], "feature_id int, pos int")
    exact = cells.cardinality(_counts(spark, sf_dir))
    close = F.abs(F.col("v_approx") - F.col("v_size")) <= F.col("v_size") * 0.05
    return (
        approx.join(names, "feature_id")
        .select(F.col("pos").alias("feature_id"), "v_approx")
        .join(exact, "feature_id")
        .select("feature_id", "v_size", close.alias("within_5_percent"))
    )


@query
def approx_cardinality_united(spark, sf_dir):
    """Sketches of three periods, stored one by one and united, against one pass over all rows and the exact sizes."""
    folder = new_folder(spark, "sketches")
    columns = [c for c in t.lineitem_raw(spark, sf_dir).columns if c not in ("empty", "derived")]
    for part, where in enumerate(t.periods("l_shipdate")):
        sinks.add_sketches(cells.value_sketches(t.lineitem_raw(spark, sf_dir, where), columns), folder, str(part))
    raw = t.lineitem_raw(spark, sf_dir)
    once = cells.united_sketches(cells.value_sketches(raw, columns))
    sizes = cells.cardinality(cells.value_counts(raw, columns, range(len(columns))))
    close = F.abs(F.col("v_approx") - F.col("v_size")) <= F.col("v_size") * 0.05
    return (
        cells.sketched_cardinality(cells.united_sketches(spark.read.parquet(folder)))
        .join(cells.sketched_cardinality(once).withColumnRenamed("v_approx", "v_once"), "feature_id")
        .join(sizes, "feature_id")
        .select("feature_id", "v_size", close.alias("within_5_percent"), (F.col("v_approx") == F.col("v_once")).alias("as_once"))
    )


@query
def cutoff_inclusive(spark, sf_dir):
    return cells.within_cutoff(cells.cardinality(_counts(spark, sf_dir)), MIN_VALUES, MAX_VALUES)


@query
def cutoff_exclusive(spark, sf_dir):
    return cells.within_cutoff(cells.cardinality(_counts(spark, sf_dir)), MIN_VALUES, MAX_VALUES, min_exclusive=True)


@query
def kept_features(spark, sf_dir):
    sizes = cells.within_cutoff(cells.cardinality(_counts(spark, sf_dir)), MIN_VALUES, MAX_VALUES)
    return kept_fields(raw_fields(t.lineitem_spec(spark)), sizes)


@query
def empty_features(spark, sf_dir):
    return cells.empty_features(t.lineitem_spec(spark), cells.cardinality(_counts(spark, sf_dir)))


@query
def value_dictionary(spark, sf_dir):
    return t.lineitem_index(spark, sf_dir).dictionary


@query
def value_dictionary_uncapped(spark, sf_dir):
    """No upper cut-off: the order keys are ranked over many sorted slices."""
    ranked = rank_ordered(_counts(spark, sf_dir), ["feature_id"], ["value"], "value_id")
    return ranked.select("feature_id", "value", "value_id", "cnt")


@query
def index_grown(spark, sf_dir):
    """The dictionary of line items that arrive in three periods; each is counted once and merged."""
    index = None
    for where in t.periods("l_shipdate"):
        added = t.lineitem_raw(spark, sf_dir, where)
        index = grow_index(index, added, t.lineitem_spec(spark), MIN_VALUES, MAX_VALUES, allow_empty=True)
    return index.dictionary()


# --- encoding ---


def _orders_in_periods(spark, sf_dir) -> tuple[list[tuple[DataFrame, GrowingIndex]], GrowingIndex]:
    """Orders of three periods, each encoded with the index as it was then, and the last index."""
    fields = t.spec(spark, "customer 0 key", "date 0 time", "priority 0 state")
    index, parts = None, []
    for where in t.periods("o_orderdate"):
        added = t.orders_raw(spark, sf_dir, where)
        index = grow_index(index, added, fields, keep=["o_orderkey"])
        parts.append((encode(added, ["customer", "date", "priority"], index.dictionary(), "o_orderkey"), index))
    return parts, index


@query
def recode_grown(spark, sf_dir):
    """Orders encoded period by period, brought to the ids of the last index without their raw values."""
    parts, last = _orders_in_periods(spark, sf_dir)
    first, second, third = [recode(rows, index, last, "o_orderkey") for rows, index in parts]
    return first.unionByName(second).unionByName(third)


@query
def recode_grown_large(spark, sf_dir):
    """The same with tables of moved ids too large for a broadcast."""
    parts, last = _orders_in_periods(spark, sf_dir)
    first, second, third = [recode(rows, index, last, "o_orderkey", budget=0) for rows, index in parts]
    return first.unionByName(second).unionByName(third)


@query
def encode_features(spark, sf_dir):
    return t.part_index(spark, sf_dir).encoded


@query
def encode_large_dictionary(spark, sf_dir):
    """Customer keys, dates and priorities of orders, with dictionaries too large for a broadcast."""
    raw = t.orders_raw(spark, sf_dir)
    columns = ["customer", "date", "priority"]
    counts = cells.value_counts(raw, columns, [0, 1, 2])
    dictionary = stage(rank_ordered(counts, ["feature_id"], ["value"], "value_id"), "dictionary")
    return encode(raw, columns, dictionary, "o_orderkey", budget=0)


@query
def encoded_value_counts(spark, sf_dir):
    index = t.lineitem_index(spark, sf_dir)
    return cells.encoded_value_counts(index.encoded, index.columns).select("feature_id", "value_id", "cnt")


@query
def vector_text(spark, sf_dir):
    index = t.part_index(spark, sf_dir)
    return index.encoded.select("p_partkey", vector_line([F.col(c) for c in index.columns]).alias("line"))


@query
def out_of_domain_cells(spark, sf_dir):
    """Line numbers and quantities checked against the nation keys of suppliers and customers."""
    coded = read(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))
    found = cells.to_cells(coded, ["l_linenumber", "quantity"], [0, 1]).withColumnRenamed("value", "value_id")
    first = read(spark, sf_dir, "supplier").select(F.lit(0).alias("feature_id"), F.col("s_nationkey").alias("value_id"))
    second = read(spark, sf_dir, "customer").select(F.lit(1).alias("feature_id"), F.col("c_nationkey").alias("value_id"))
    return cells.out_of_domain_cells(found, first.unionByName(second).distinct())


# --- text ---


@query
def unescape_xml(spark, sf_dir):
    numbered = F.replace(F.replace("html", F.lit("&middot;"), F.lit("&#183;")), F.lit("&copy;"), F.lit("&#xA9;"))
    return read(spark, sf_dir, "pages").select("page_id", tx.unescape_xml(numbered).alias("text"))


@query
def strip_strong(spark, sf_dir):
    marked = F.regexp_replace("html", "<(/?)(?:b|h1)>", "<$1strong>")
    return read(spark, sf_dir, "pages").select("page_id", tx.strip_strong(marked).alias("text"))


@query
def strip_web_address(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.strip_web_address(F.col("url")).alias("text"))


@query
def normalize_text(spark, sf_dir):
    return t.document_lines(spark, sf_dir).select(
        "doc_id", "line_no", tx.normalize_text(F.col("value")).alias("text")
    )


@query
def extract_text_fields(spark, sf_dir):
    return extract_text(t.page_log_lines(spark, sf_dir), "page_id", strict=True)


@query
def word_count(spark, sf_dir):
    return counting.word_count(t.document_lines(spark, sf_dir))


@query
def line_index(spark, sf_dir):
    return counting.line_index(t.document_lines(spark, sf_dir), "doc_id", "line_no").select("line_id", "value")


# --- mixture model: single steps ---


def _lineitem_patterns(spark, sf_dir):
    index = t.lineitem_index(spark, sf_dir)
    patterns = cl.distinct_patterns(stage(index.encoded, "encoded"), index.columns)
    return patterns, index.columns, stage(cl.data_domain(patterns, index.columns), "domain")


def _part_model(spark, sf_dir):
    index = t.part_index(spark, sf_dir)
    encoded = stage(index.encoded, "encoded")
    domain = stage(cl.data_domain(cl.distinct_patterns(encoded, index.columns), index.columns), "domain")
    theta, prior = t.arithmetic_start(domain)
    return encoded, index.columns, cl.Model(theta, prior, domain)


def _statistics(spark, sf_dir, hard: bool, broadcast: set[int] | None = None):
    patterns, columns, domain = _lineitem_patterns(spark, sf_dir)
    theta, prior = t.arithmetic_start(domain)
    return cl.estep_statistics(patterns, columns, theta, prior, domain, hard, broadcast), domain


def _present(statistics: DataFrame) -> DataFrame:
    return statistics.where("feature_id >= 0").withColumn("n", rounded("n"))


def _by_cluster(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("p").alias("k", "p")).withColumn("p", rounded("p"))


@query
def nb_init(spark, sf_dir):
    domain = _lineitem_patterns(spark, sf_dir)[2]
    return _model_table(cl.Model(mx.random_theta(domain, CLUSTERS, 7), mx.random_prior(CLUSTERS, 7), domain))


@query
def nb_init_uniform(spark, sf_dir):
    domain = _lineitem_patterns(spark, sf_dir)[2]
    return _model_table(cl.Model(mx.uniform_theta(domain, CLUSTERS), [1 / CLUSTERS] * CLUSTERS, domain))


@query
def nb_posterior(spark, sf_dir):
    rows, columns, model = _part_model(spark, sf_dir)
    return _by_cluster(cl.posterior(rows, columns, model), "p_partkey")


@query
def nb_posterior_joined(spark, sf_dir):
    """The same with a model that is joined to the rows rather than broadcast."""
    rows, columns, model = _part_model(spark, sf_dir)
    return _by_cluster(cl.posterior(rows, columns, model, model_bytes=0), "p_partkey")


@query
def nb_assign_argmax(spark, sf_dir):
    rows, columns, model = _part_model(spark, sf_dir)
    return cl.assign(rows, columns, model, how="argmax").select("p_partkey", "cluster")


@query
def nb_assign_sampled(spark, sf_dir):
    rows, columns, model = _part_model(spark, sf_dir)
    return cl.assign(rows, columns, model, keys=["p_partkey"], seed=3).select("p_partkey", "cluster")


@query
def nb_soft_stats(spark, sf_dir):
    return _present(_statistics(spark, sf_dir, hard=False)[0])


@query
def nb_soft_stats_joined(spark, sf_dir):
    """The same with two features broadcast and three joined to the rows."""
    return _present(_statistics(spark, sf_dir, hard=False, broadcast={0, 3})[0])


@query
def nb_hard_stats(spark, sf_dir):
    return _present(_statistics(spark, sf_dir, hard=True)[0])


@query
def nb_prior_cells(spark, sf_dir):
    mass = mx.cluster_mass(_statistics(spark, sf_dir, hard=False)[0], "cells")
    return mass.withColumn("mass", rounded("mass"))


@query
def nb_prior_records(spark, sf_dir):
    mass = mx.cluster_mass(_statistics(spark, sf_dir, hard=False)[0], "records")
    return mass.withColumn("mass", rounded("mass"))


@query
def nb_mstep(spark, sf_dir):
    statistics, domain = _statistics(spark, sf_dir, hard=False)
    return mx.update_theta(stage(statistics, "statistics"), mx.domain_sizes(domain)).withColumn("p", rounded("p"))


# --- mixture model: whole fits ---


def fit_lineitem(spark, sf_dir, iterations: int, **options) -> cl.Model:
    index = t.lineitem_index(spark, sf_dir)
    encoded = stage(index.encoded, "encoded")
    return cl.fit(encoded, index.columns, CLUSTERS, iterations, start=t.arithmetic_start, stored=True, **options)


def _model_table(model: cl.Model) -> DataFrame:
    """theta, and the prior as feature -1."""
    prior = model.prior_table().select(F.lit(-1).alias("feature_id"), F.lit(0).alias("value_id"), "k", "p")
    return model.theta.select("feature_id", "value_id", "k", "p").unionByName(prior).withColumn("p", rounded("p"))


@query
def nb_train_soft(spark, sf_dir):
    return _model_table(fit_lineitem(spark, sf_dir, 3))


@query
def nb_train_hard(spark, sf_dir):
    return _model_table(fit_lineitem(spark, sf_dir, 2, mode="hard"))


@query
def nb_train_records(spark, sf_dir):
    return _model_table(fit_lineitem(spark, sf_dir, 2, prior="records"))


@query
def nb_train_pseudo_counts(spark, sf_dir):
    """With given pseudo-counts in place of 1/K and 1/V."""
    return _model_table(fit_lineitem(spark, sf_dir, 2, alpha=0.75, beta=0.25))


@query
def nb_trace(spark, sf_dir):
    trace = sinks.trace_table(fit_lineitem(spark, sf_dir, 2, keep_trace=True))
    return trace.withColumn("n", rounded("n")).withColumn("p", rounded("p"))


@query
def nb_train_resumed(spark, sf_dir):
    """Three iterations in two runs: the second goes on from what the first has stored."""
    state = new_folder(spark, "state")
    fit_lineitem(spark, sf_dir, 2, state=state)
    return _model_table(fit_lineitem(spark, sf_dir, 3, state=state))


@query
def nb_score(spark, sf_dir):
    """Two soft iterations on parts, then the probabilities of every part."""
    index = t.part_index(spark, sf_dir)
    encoded = stage(index.encoded, "encoded")
    model = cl.fit(encoded, index.columns, CLUSTERS, 2, start=t.arithmetic_start, stored=True)
    return _by_cluster(cl.posterior(encoded, index.columns, model), "p_partkey")


@query
def nb_saved_model_score(spark, sf_dir):
    """The same through a model that was written and read back."""
    index = t.part_index(spark, sf_dir)
    encoded = stage(index.encoded, "encoded")
    path = new_folder(spark, "model")
    sinks.save_model(cl.fit(encoded, index.columns, CLUSTERS, 2, start=t.arithmetic_start, stored=True), path)
    return _by_cluster(cl.posterior(encoded, index.columns, sinks.load_model(spark, path)), "p_partkey")


# --- vectors, logistic regression ---


@query
def parse_vectors_scan(spark, sf_dir):
    """Parts as lines of ids, parsed back."""
    index = t.part_index(spark, sf_dir)
    line = vector_line([F.col(c) for c in index.columns])
    return parse_vectors(index.encoded.select("p_partkey", line.alias("value")), len(index.columns), "p_partkey")


@query
def vectors_checked(spark, sf_dir):
    """Line items as lines of ids with words and too large numbers among them, good and bad lines from one scan."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    word = F.when(F.col("l_discount") == 0.05, F.concat(F.lit("x"), quantity)).when(F.col("l_discount") == 0.02, "")
    large = (F.col("l_orderkey").cast("bigint") * 10_000_000).cast("string")
    line = F.concat_ws(" ", "l_linenumber", F.coalesce(word, quantity), large)
    return checked_vectors(read(spark, sf_dir, "lineitem").select(line.alias("value")), 3)


@query
def labelled_checked(spark, sf_dir):
    """Line items as labelled lines with words, infinite numbers and too few tokens among them, counted by fault."""
    label = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "-1").otherwise("none")
    tax = F.when(F.col("l_tax") == 0.03, "NaN").when(F.col("l_tax") == 0.04, "1e999").when(F.col("l_tax") > 0.05, None)
    number = F.col("l_linenumber").cast("string")
    line = F.concat_ws(" ", label, number, F.coalesce(tax, F.when(F.col("l_tax") <= 0.05, F.concat(number, F.lit(".5e1")))))
    points = checked_labelled(read(spark, sf_dir, "lineitem").select(line.alias("value")), 2)
    sums = [rounded(F.sum(F.col("x")[i])).alias(f"x{i}") for i in range(2)]
    return points.groupBy("y", "fault").agg(F.count("*").alias("n"), F.count("line").alias("lines"), *sums)


@query
def labelled_scan(spark, sf_dir):
    """Line items as labelled lines, parsed back and added up by label."""
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)
    line = F.concat_ws(" ", label.cast("string"), F.col("l_quantity").cast("int"), "l_linenumber", F.lit("7 8"))
    points = parse_labelled(read(spark, sf_dir, "lineitem").select(line.alias("value")), 3)
    sums = [rounded(F.sum(F.col("x")[i])).alias(f"x{i}") for i in range(3)]
    return points.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dimensions"), *sums)


@query
def vector_sum(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    both = vectors.select("label", F.posexplode(add_vectors(F.col("e"), F.reverse(F.col("e")))).alias("i", "x"))
    return both.groupBy("label", "i").agg(rounded(F.sum("x")).alias("total"))


@query
def logreg_gradient(spark, sf_dir):
    points = t.labelled_lineitem(spark, sf_dir)
    x = logistic.components(points, "x", len(t.LOGISTIC_START))
    row = logistic.gradient(points, F.col("y"), x, t.LOGISTIC_START)
    return row.select(*[rounded(c).alias(c) for c in row.columns])


@query
def logreg_train(spark, sf_dir):
    points = t.labelled_lineitem(spark, sf_dir)
    x = logistic.components(points, "x", len(t.LOGISTIC_START))
    weights = logistic.train_logistic(
        points, F.col("y"), x, 3, weights=t.LOGISTIC_START, step=t.LOGISTIC_STEP
    )
    return spark.createDataFrame(list(enumerate(weights)), "i int, w double").withColumn("w", rounded("w"))
