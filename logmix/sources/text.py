"""Readers of line-based text data. Missing cells are NULL; short rows miss their last cells; nothing is shifted."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logmix.functions.text import split_lines


# The number that each row of a file set gets where it is read.
LINE = "_line"


def numbered(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """A scan with a number per row, which a retried task repeats; spread over ``partitions`` tasks only if asked to.

    The number is taken at the scan and carried along, so neither draws nor join slots depend on what comes after.
    """
    rows = scan.withColumn(LINE, F.monotonically_increasing_id())
    return rows.repartition(partitions, LINE) if partitions else rows


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Lines of a file, folder or glob as column ``value``; ``partitions`` spreads them over that many tasks."""
    return read_numbered_lines(spark, path, partitions).select("value") if partitions else spark.read.text(path)


def read_numbered_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """``(value, _line)``."""
    return numbered(spark.read.text(path), partitions)


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row ``(keep…, line_no, value)`` per line of a text column."""
    return df.select(*keep, F.posexplode(split_lines(F.col(text))).alias("line_no", "value"))


def _cell(parts: Column, position: int) -> Column:
    return F.nullif(F.get(parts, F.lit(position)), F.lit(""))


def split_tsv(lines: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Cut column ``value`` at TABs into named string columns."""
    parts = F.split("value", "\t", -1)
    return lines.select(*keep, *[_cell(parts, i).alias(name) for i, name in enumerate(columns)])


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    return split_tsv(read_lines(spark, path), columns)


def line_width() -> Column:
    """The number of TAB-separated cells of column ``value``."""
    return F.size(F.split("value", "\t", -1))


def observe_widths(lines: DataFrame, width: int) -> tuple[DataFrame, Observation]:
    """``lines``, and counts that the next action over them fills in, without another scan.

    The counts are ``lines``, one for each number of cells below ``width`` (``cells_1`` …) and ``wider``; a missing line counts
    as one of a single cell.
    """
    found = F.coalesce(line_width(), F.lit(1))
    counts = [F.count_if(found == n).alias(f"cells_{n}") for n in range(1, width)]
    seen = Observation(f"widths-{uuid.uuid4().hex}")
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"), *counts, F.count_if(found > width).alias("wider")), seen


def odd_widths(seen: Observation) -> dict[str, int]:
    """The counts of ``observe_widths`` that are not zero, once an action has run; without ``lines``."""
    return {name: n for name, n in seen.get.items() if n and name != "lines"}


def row_width_audit(lines: DataFrame, width: int) -> DataFrame:
    """``(width, is_valid, lines)``: how many lines have how many TAB-separated cells."""
    found = lines.select(line_width().alias("width"))
    return found.groupBy("width").agg(F.count("*").alias("lines")).withColumn("is_valid", F.col("width") == width)


def parse_spec(lines: DataFrame) -> DataFrame:
    """``(pos, name, flag, family)`` from ``(pos, value)``; the parts are separated by a space or a TAB."""
    parts = F.split("value", "[ \t]", 3)
    return lines.select(
        "pos",
        F.get(parts, F.lit(0)).alias("name"),
        F.get(parts, F.lit(1)).cast("int").alias("flag"),
        F.get(parts, F.lit(2)).alias("family"),
    )


def raw_fields(spec: DataFrame) -> DataFrame:
    """Fields to use (flag 0), at their original positions; derived ones (flag 1) are left out."""
    return spec.where("flag = 0")


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """A field spec with one line per raw column; a field's position is its line number, counted from 0.

    The file is as long as a table is wide, so it is read as one text to keep the line order.
    """
    text = spark.read.text(path, wholetext=True)
    return parse_spec(lines_of(text, "value").withColumnRenamed("line_no", "pos").where("value <> ''"))


# Texts that are numbers; anything else in a number's place is a fault.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Columns of a checked table: what is wrong with a line (NULL: nothing), and the line if something is.
FAULT, LINE_TEXT = "fault", "line"


def _first_fault(cells: Sequence[Column], numbers: Sequence[Column], pattern: str) -> Column:
    """``<place>: not_a_number`` or ``<place>: out_of_range`` of the first cell that has a text but no number, else NULL."""
    kind = lambda text: F.when(text.rlike(pattern), "out_of_range").otherwise("not_a_number")
    return F.coalesce(
        *[
            F.when(text.isNotNull() & number.isNull(), F.concat(F.lit(f"{i}: "), kind(text)))
            for i, (text, number) in enumerate(zip(cells, numbers))
        ]
    )


def checked_vectors(lines: DataFrame, features: int, *keep: str) -> DataFrame:
    """``(keep…, f0 …, fault, line)`` from space-separated ids: the first ``features`` of each line, negative = missing.

    A cell that holds something else than a 32-bit whole number is a fault of its line, whatever the session's ANSI setting; its
    own id is missing then. Missing and empty cells are no fault.
    """
    parts = F.split("value", " ", -1)
    cells = [_cell(parts, d) for d in range(features)]
    ids = [c.try_cast("int") for c in cells]
    fault = _first_fault(cells, ids, _WHOLE)
    checked = lines.select(*keep, "value", *[F.when(v >= 0, v).alias(f"f{d}") for d, v in enumerate(ids)], fault.alias(FAULT))
    return _with_line(checked)


def checked_labelled(lines: DataFrame, dimensions: int, *keep: str) -> DataFrame:
    """``(keep…, y double, x array<double>, fault, line)`` from lines ``y x1 x2 …``; tokens beyond ``dimensions`` are ignored.

    A token that is no finite decimal number is a fault, and so is a line of fewer tokens (``too_few_numbers``).
    """
    # Columns that are used several times, so that a line is split once and a token is matched and cast once: what one selection
    # makes, the next ones read.
    tokens = lines.select(*keep, "value", F.split("value", " ", -1).alias("_parts"))
    # A missing token is no fault of its own.
    plain = lambda i: F.get("_parts", F.lit(i)).rlike(_DECIMAL)
    cast = lambda i: F.get("_parts", F.lit(i)).try_cast("double")
    finite = lambda v: F.when(F.abs(v) < F.lit(float("inf")), v)
    read = [F.when(plain(i), cast(i)).alias(f"_n{i}") for i in range(dimensions + 1)]
    numbers = [finite(F.col(f"_n{i}")) for i in range(dimensions + 1)]
    cells = [F.get("_parts", F.lit(i)) for i in range(dimensions + 1)]
    short = F.when(F.coalesce(F.size("_parts"), F.lit(0)) <= dimensions, "too_few_numbers")
    fault = F.coalesce(_first_fault(cells, numbers, _DECIMAL), short)
    found = tokens.select(*keep, "value", "_parts", *read)
    checked = found.select(*keep, "value", numbers[0].alias("y"), F.array(*numbers[1:]).alias("x"), fault.alias(FAULT))
    return _with_line(checked)


def _with_line(checked: DataFrame) -> DataFrame:
    kept = [c for c in checked.columns if c != "value"]
    return checked.select(*kept, F.when(F.col(FAULT).isNotNull(), F.col("value")).alias(LINE_TEXT))


def _where(checked: DataFrame, condition: Column) -> DataFrame:
    """``checked`` by a condition on its columns.

    Spark would move the filter before the selections that make these columns, and there split the line and match its tokens again for
    each place that needs them. It does not move one that reads a row number.
    """
    rows = checked.withColumn("_row", F.monotonically_increasing_id())
    return rows.where(condition & (F.col("_row") >= 0)).select(*checked.columns)


def sound(checked: DataFrame) -> DataFrame:
    """The rows without a fault, as the plain parser returns them."""
    return _where(checked, F.col(FAULT).isNull()).drop(FAULT, LINE_TEXT)


def rejected(checked: DataFrame, *keep: str) -> DataFrame:
    """``(keep…, fault, line)`` of the others."""
    return _where(checked, F.col(FAULT).isNotNull()).select(*keep, FAULT, LINE_TEXT)


def _refuse(checked: DataFrame) -> DataFrame:
    """All rows; a fault ends the job, whatever the ANSI setting."""
    fine = F.assert_true(F.col(FAULT).isNull(), F.concat_ws(" in line: ", FAULT, LINE_TEXT))
    return _where(checked, fine.isNull()).drop(FAULT, LINE_TEXT)


def parse_vectors(lines: DataFrame, features: int, *keep: str) -> DataFrame:
    """``(keep…, f0 …)`` as by ``checked_vectors``; a line with a fault is an error."""
    return _refuse(checked_vectors(lines, features, *keep))


def read_vectors(spark: SparkSession, path: str | list[str], features: int) -> DataFrame:
    return parse_vectors(read_lines(spark, path), features)


def parse_labelled(lines: DataFrame, dimensions: int) -> DataFrame:
    """``(y, x array<double>)`` as by ``checked_labelled``; a line with a fault is an error."""
    return _refuse(checked_labelled(lines, dimensions))


def read_labelled(spark: SparkSession, path: str | list[str], dimensions: int = 16) -> DataFrame:
    return parse_labelled(read_lines(spark, path), dimensions)
