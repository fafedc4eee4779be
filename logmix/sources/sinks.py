"""Writers. Each replaces what was at its path, once all that is to take its place is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.functions.vectors import vector_line
from logmix.plans.clustering import Model
from logmix.plans.growing import GrowingIndex
from logmix.storage import replace


def _in_parts(df: DataFrame, *parts: str) -> DataFrame:
    """Rows of one part together, so that a task writes few folders; AQE splits large parts and joins small ones."""
    return df.hint("rebalance", *parts) if parts else df


def write_lines(df: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """A single string column as text lines, at most ``records_per_file`` of them in a file."""
    replace(df.sparkSession, path, df.write.option("maxRecordsPerFile", records_per_file or 0).text)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A table, in one folder per value of ``by``."""
    replace(df.sparkSession, path, _in_parts(df, *by).write.partitionBy(*by).parquet)


def write_dictionary_text(dictionary: DataFrame, path: str, with_counts: bool = True) -> None:
    """Lines ``id TAB value [TAB count]`` in id order, one folder ``feature_id=<i>`` per feature.

    Sorted by feature, so there are fewer files than tasks and features together.
    """
    parts = ["value_id", "value", "cnt"] if with_counts else ["value_id", "value"]
    lines = dictionary.orderBy("feature_id", "value_id").select(
        "feature_id", F.concat_ws("\t", *[F.col(c).cast("string") for c in parts]).alias("value")
    )
    replace(dictionary.sparkSession, path, lines.write.partitionBy("feature_id").text)


def write_kept(kept: DataFrame, path: str) -> None:
    """The spec lines of the kept features, in encoded column order; as short as the table is narrow."""
    line = F.concat_ws(" ", "name", F.col("flag").cast("string"), "family")
    write_lines(kept.orderBy("feature_id").select(line.alias("value")).coalesce(1), path)


def write_vectors(encoded: DataFrame, columns: Sequence[str], path: str, records_per_file: int | None = None) -> None:
    """Encoded rows as space-separated ids, -1 for a missing cell."""
    write_lines(encoded.select(vector_line([F.col(c) for c in columns]).alias("value")), path, records_per_file)


def write_vector_parts(encoded: DataFrame, columns: Sequence[str], path: str) -> None:
    """As ``write_vectors``, in one folder ``part=<part>`` per value of column ``part``."""
    lines = encoded.select("part", vector_line([F.col(c) for c in columns]).alias("value"))
    replace(encoded.sparkSession, path, _in_parts(lines, "part").write.partitionBy("part").text)


def score_line(columns: Sequence[str], score: str, is_vector: bool):
    """``ids TAB score``: the cluster, or the probabilities joined by spaces."""
    value = F.col(score)
    if is_vector:
        value = F.array_join(F.transform(value, lambda p: p.cast("string")), " ")
    return F.concat_ws("\t", vector_line([F.col(c) for c in columns]), value.cast("string"))


def write_scores(
    scored: DataFrame, columns: Sequence[str], score: str, path: str, records_per_file: int | None = None
) -> None:
    is_vector = dict(scored.dtypes)[score].startswith("array")
    write_lines(scored.select(score_line(columns, score, is_vector).alias("value")), path, records_per_file)


def save_model(model: Model, path: str) -> None:
    write_table(model.theta, f"{path}/theta")
    write_table(model.domain, f"{path}/domain")
    write_table(model.prior_table(), f"{path}/prior")


def load_model(spark: SparkSession, path: str) -> Model:
    prior = spark.read.parquet(f"{path}/prior").orderBy("k").collect()  # one row per cluster
    return Model(
        spark.read.parquet(f"{path}/theta"), [r["p"] for r in prior], spark.read.parquet(f"{path}/domain")
    )


def write_rejected(lines: DataFrame, path: str) -> None:
    """Lines ``fault TAB line``."""
    write_lines(lines.select(F.concat_ws("\t", "fault", "line").alias("value")), path)


def add_sketches(sketches: DataFrame, path: str, part: str) -> None:
    """``(feature_id, sketch)`` of one file set beside those of others, as ``part=<part>``; an earlier table of that part goes."""
    write_table(sketches, f"{path}/part={part}")


def save_index(index: GrowingIndex, path: str) -> None:
    """The values and kept features so far; an index may be saved to the folder it was loaded from."""
    write_table(index.values, f"{path}/values")
    write_table(index.kept, f"{path}/kept")


def load_index(spark: SparkSession, path: str) -> GrowingIndex:
    return GrowingIndex(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/kept"))


def trace_table(model: Model) -> DataFrame:
    """``(iter, feature_id, value_id, k, n, p)`` of every iteration of a fit that kept its trace.

    The prior stands as feature -1, without statistics.
    """
    if model.state is None:
        raise ValueError("the fit kept no trace")
    return model.state.table()
