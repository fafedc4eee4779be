"""The given tables in the shape of the library's inputs: raw string columns, specs, lines and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.operators.mixture import normalize_theta, with_clusters
from logmix.plans.indexing import Index, index_features
from logmix.sources.text import lines_of, parse_spec

CLUSTERS = 4
# Cut-offs of the indexing queries.
MIN_VALUES, MAX_VALUES = 2, 1000
LOGISTIC_START = [0.1, -0.2, 0.3, -0.4, 0.5]
LOGISTIC_STEP = 1e-5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(spark: SparkSession, *lines: str) -> DataFrame:
    return parse_spec(spark.createDataFrame(list(enumerate(lines)), "pos int, value string"))


# Conditions on a date that cut a table into file sets which arrive one after the other.
def periods(date: str) -> list[str]:
    return [f"{date} < '1997-01-01'", f"{date} >= '1997-01-01' AND {date} < '1999-01-01'", f"{date} >= '1999-01-01'"]


def lineitem_raw(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Nine string columns: five categorical ones (no discount counts as missing), a constant, an empty one, a key, and
    a derived one without values."""
    return read(spark, sf_dir, "lineitem").where(where).select(
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_linenumber").cast("string").alias("linenumber"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).cast("string").alias("discount"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.lit("z").alias("constant"),
        F.lit("").alias("empty"),
        F.col("l_orderkey").cast("string").alias("orderkey"),
        F.lit("").alias("derived"),
    )


def lineitem_spec(spark: SparkSession) -> DataFrame:
    return spec(
        spark,
        "returnflag 0 state",
        "linestatus 0 state",
        "linenumber 0 place",
        "discount 0 price",
        "quantity 0 price",
        "constant 0 other",
        "empty 0 other",
        "orderkey 0 key",
        "derived 1 other",
    )


def lineitem_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_features(lineitem_raw(spark, sf_dir), lineitem_spec(spark), MIN_VALUES, MAX_VALUES, allow_empty=True)


def part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and three categorical columns; the type SMALL counts as missing, the price as derived."""
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("brand"),
        F.nullif(F.col("p_type"), F.lit("SMALL")).alias("type"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_size").cast("string").alias("size"),
    )


def part_spec(spark: SparkSession) -> DataFrame:
    return spec(spark, "brand 0 kind", "type 0 kind", "price 1 money", "size 0 measure")


def part_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_features(
        part_raw(spark, sf_dir), part_spec(spark), MIN_VALUES, MAX_VALUES, keep=["p_partkey"]
    )


def arithmetic_start(domain: DataFrame, clusters: int = CLUSTERS) -> tuple[DataFrame, list[float]]:
    """A start model that plain SQL can repeat, without symmetric clusters."""
    d, v, k = F.col("feature_id"), F.col("value_id"), F.col("k")
    x = (F.lit(1) + (d * 31 + v * 17 + k * 7 + v * k * 3) % 11).cast("double")
    return normalize_theta(with_clusters(domain, clusters).withColumn("x", x)), [1.0 / clusters] * clusters


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(read(spark, sf_dir, "documents"), "text", "doc_id")


def orders_raw(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Key, customer, date and priority; the priority 5-LOW counts as missing."""
    return read(spark, sf_dir, "orders").where(where).select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )


def page_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of a 63-column log: the title, the whole page and its address in the text fields."""
    flat = F.regexp_replace("html", r"\s", " ")
    title = F.regexp_extract(flat, "<title>(.*?)</title>", 1)
    text = {9: title, 14: title, 15: flat, 16: F.col("url"), 17: F.col("url")}
    cells = [text.get(i, F.lit(f"c{i}")) for i in range(63)]
    return read(spark, sf_dir, "pages").select("page_id", F.concat_ws("\t", *cells).alias("value"))


def labelled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y`` is +1 for returned items, else -1; ``x`` holds five scaled measures."""
    return read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"),
        F.array(
            F.col("l_quantity") / 50,
            F.col("l_extendedprice") / 100000,
            F.col("l_discount") * 10,
            F.col("l_tax") * 10,
            F.col("l_linenumber") / 7,
        ).alias("x"),
    )

