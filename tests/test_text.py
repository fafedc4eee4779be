from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from logmix.functions import text as tx
from logmix.plans.counting import word_count
from logmix.sources.text import read_tsv
from logmix.plans.extraction import LOG_COLUMNS, LOG_WIDTH, TEXT_COLUMNS, extract_text


def apply(spark, function, values):
    data = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in data.orderBy("i").select(function(F.col("t")).alias("o")).collect()]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a &lt;b&gt; &amp;lt; &#65;&#x42; &#38;lt; &bogus; & z", "a <b> &lt; AB &lt; &bogus; & z"),
        ("&amp;amp;amp;", "&amp;amp;"),
        ("&#0000065;&#X1F600;&#128512;", "A\U0001f600\U0001f600"),
        ("&#x110000; &#xD800; &#99999999999999999999; &#xfffffffffff;",) * 2,
        ("&#12ab; &#; &#x; &lt &", "&#12ab; &#; &#x; &lt &"),
        ("&quot;&apos;", "\"'"),
        ("", ""),
        (None, None),
    ],
)
def test_unescape_xml(spark, given, expected):
    assert apply(spark, tx.unescape_xml, [given]) == [expected]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("visit <strong>www.foo.com</strong> & save 50%", "visit foo save "),
        ("http://shop.a-b.co.uk/x?id=12", "http shop a b uk x id "),
        ("café “q” 3.5.com", "café “q” "),
        (".com", " com"),
        ("", ""),
        ("&lt;strong&gt;x&lt;/strong&gt;", "x"),
        ("VISIT <STRONG class='a'>Www.Foo.NET</STRONG>", "visit foo"),
    ],
)
def test_normalize_text(spark, given, expected):
    assert apply(spark, tx.normalize_text, [given]) == [expected]


def test_domain_suffix_equals_the_lazy_prefix_form(spark):
    draw = random.Random(1)
    parts = ["a", ".", ".com", ".co", ".net", "\n", "x", " ", ".info", "community", ".tv"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(3000)]
    lazy = re.compile(rf"(?i)(.+?)(\.({tx.TOP_LEVEL_DOMAINS}))")
    assert apply(spark, tx.strip_domain_suffix, texts) == [lazy.sub(r"\1", t) for t in texts]


def test_long_line_is_cleaned_whole(spark):
    text = "www.shop.com &amp; <strong>x</strong> 12 " * 20_000
    assert apply(spark, tx.normalize_text, [text]) == ["shop x " * 20_000]


def test_split_lines(spark):
    given = ["a\nb", "a\r\nb\n", "", "\n", "a\n\n", "a\rb"]
    expected = [["a", "b"], ["a", "b"], [], [""], ["a", ""], ["a", "b"]]
    assert apply(spark, tx.split_lines, given) == expected


def test_word_count(spark):
    lines = spark.createDataFrame([("a b  a",), ("b  ",), ("",), ("   ",)], "value string")
    assert rows(word_count(lines), "word") == [("", 2), ("a", 2), ("b", 2)]


def test_word_count_with_a_hot_word(spark):
    lines = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("value")
    )
    assert word_count(lines).where("word = 'hot'").first()["cnt"] == 10_000


def log_line(**fields):
    return "\t".join(fields.get(name, f"c{i}") for i, name in enumerate(LOG_COLUMNS))


def test_log_columns(spark, tmp_path):
    assert LOG_WIDTH == len(set(LOG_COLUMNS)) == 63
    assert [LOG_COLUMNS.index(c) for c in TEXT_COLUMNS] == [9, 14, 15, 16, 17]
    (tmp_path / "log.tsv").write_text(log_line(title="T", c62="") + "\n")
    row = read_tsv(spark, str(tmp_path / "log.tsv"), LOG_COLUMNS).first()
    assert row["title"] == "T" and row["c0"] == "c0" and row["c62"] is None


def test_extract_text(spark):
    good = log_line(
        exactCanonicalQuery="Buy Shoes 24", title="A &amp; B", description="", displayUrl="www.foo.com", targetUrl="x.net/1 "
    )
    lines = spark.createDataFrame([(1, good), (2, "short\tline")], "id int, value string")
    got = extract_text(lines, "id").orderBy("id").collect()
    assert got[0].asDict() == {
        "id": 1,
        "exactCanonicalQuery": "buy shoes ",
        "title": "a b",
        "description": "",
        "displayUrl": "foo",
        "targetUrl": "x ",
        "line": "buy shoes \ta b\t\tfoo\tx",
    }
    assert got[1]["line"] == "" and got[1]["title"] == ""
    assert extract_text(lines.where("id = 1"), strict=True).count() == 1
    with pytest.raises(Exception, match="expected 63 cells, found 2"):
        extract_text(lines, strict=True).collect()


def test_clean_up_is_one_narrow_stage(spark):
    lines = spark.createDataFrame([("x",)], "value string")
    plan = extract_text(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
