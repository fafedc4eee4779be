"""A line is split, and its tokens are matched, once: the filter on its fault does not repeat that."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logmix.sources import text


@pytest.mark.parametrize("parse", [
    lambda lines: text.parse_labelled(lines, 3),
    lambda lines: text.sound(text.checked_labelled(lines, 3)),
    lambda lines: text.rejected(text.checked_labelled(lines, 3)),
])
def test_tokens_are_read_once(spark, parse):
    plan = parse(spark.range(9).select(F.concat_ws(" ", "id", F.lit("1 2 3")).alias("value")))._jdf.queryExecution().optimizedPlan().toString()
    # Four tokens are cast once each.
    assert plan.count("split(") == 1
    assert plan.count("try_cast(") == 4


def test_rows_and_faults_stay(spark):
    given = ["1 2 3 4", "x 2 3 4", "1 1e999 3 4", "1 2", "-1 .5 3e1 4 9", None]
    lines = spark.createDataFrame(list(enumerate(given)), "n int, value string")
    checked = text.checked_labelled(lines, 3, "n")
    assert rows(text.sound(checked), "n") == [(0, 1.0, [2.0, 3.0, 4.0]), (4, -1.0, [0.5, 30.0, 4.0])]
    assert [tuple(r)[:2] for r in text.rejected(checked, "n").orderBy("n").collect()] == [
        (1, "0: not_a_number"), (2, "1: out_of_range"), (3, "too_few_numbers"), (5, "too_few_numbers"),
    ]
