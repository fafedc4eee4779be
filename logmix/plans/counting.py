"""Word count and line numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.functions.text import split_words
from logmix.operators.ranking import rank_ordered


def word_count(lines: DataFrame) -> DataFrame:
    """``(word, cnt)`` over column ``value``; hot words shrink to one row per task before the shuffle."""
    words = lines.select(F.explode(split_words(F.col("value"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def line_index(lines: DataFrame, *tie_break: str) -> DataFrame:
    """Number all lines from 1 in order of column ``value``.

    ``tie_break`` tells equal lines apart, so that copies of one line spread over many sorted slices.
    """
    ranked = rank_ordered(lines, [], ["value", *tie_break], "_rank")
    return ranked.withColumn("line_id", F.col("_rank") + 1).drop("_rank")

