"""Tags without an end are searched for once a line, and all others go as by the plain pattern."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from logmix.functions.text import strip_strong

PLAIN = r"(?i)(<strong.*?>)(.+?)(</strong>)"


def test_equals_the_plain_pattern(spark):
    draw = random.Random(7)
    parts = ["<strong", "<STRONG>", ">", "</strong>", "</Strong>", "<strong>", "a", " b", "\n", "\r", " ", "\u0085", "<", "$1"]
    given = ["".join(draw.choices(parts, k=draw.randrange(16))) for _ in range(3000)] + [None, "<strong></strong>x</strong>"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    plain = F.regexp_replace("t", F.lit(PLAIN), F.lit("$2"))
    found = df.select("t", strip_strong(F.col("t")).alias("new"), plain.alias("old"))
    assert found.where("NOT new <=> old").collect() == []
    assert found.where("new <> t").count() > 200


def test_open_tags_are_no_squares(spark):
    df = spark.createDataFrame([("<strong>x>" * 1500,)], "t string")
    began = time.time()
    assert df.where(strip_strong(F.col("t")) == F.col("t")).count() == 1
    assert time.time() - began < 10
