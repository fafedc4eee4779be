"""From raw string columns to a value dictionary, the features worth keeping, and integer-coded rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmix.operators.cells import cardinality, empty_features, to_cells, value_counts, within_cutoff
from logmix.operators.lookup import BROADCAST_BYTES, Keyed, lookup, split_budget
from logmix.operators.ranking import rank_ordered
from logmix.sources.text import raw_fields
from logmix.storage import stage

_LAST_ID = 2**31 - 1
# Memory per dictionary entry in a broadcast, beside the value itself.
_ENTRY_BYTES = 64


@dataclass(frozen=True)
class Index:
    """``dictionary (feature_id, value, value_id, cnt)``, ``kept (feature_id, pos, name, flag, family)`` and
    ``encoded``: the kept columns as ``f0 …`` (listed in ``columns``), after any columns carried along."""

    dictionary: DataFrame
    kept: DataFrame
    encoded: DataFrame
    columns: list[str] = field(default_factory=list)


def project_features(raw: DataFrame, spec: DataFrame, *keep: str) -> tuple[DataFrame, list[str], list[int]]:
    """The raw (flag 0) columns by position. A spec has one row per column of ``raw``, so it is read on the driver."""
    positions = sorted(r["pos"] for r in raw_fields(spec).select("pos").collect())
    carried = set(keep)
    data = [c for c in raw.columns if c not in carried]
    columns = [data[p] for p in positions]
    return raw.select(*keep, *columns), columns, positions


def kept_fields(spec: DataFrame, sizes: DataFrame) -> DataFrame:
    """The spec rows whose ``pos`` is in ``sizes.feature_id``, renumbered 0 … in order of position.

    One row per column of the raw table, so numbering them in one task is fine.
    """
    kept = spec.join(sizes, spec["pos"] == sizes["feature_id"], "left_semi")
    number = (F.row_number().over(Window.orderBy("pos")) - 1).cast("int")
    return kept.select(number.alias("feature_id"), "pos", "name", "flag", "family")


def build_dictionary(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Value ids in string order, within each kept feature. ``counts.feature_id`` holds raw positions.

    ``counts`` is read twice and should be stored.
    """
    ids = kept.select(F.col("feature_id").alias("new_id"), "pos")
    known = counts.join(F.broadcast(ids), counts["feature_id"] == ids["pos"]).select(  # one row per column
        F.col("new_id").alias("feature_id"), "value", "cnt"
    )
    ranked = rank_ordered(known, ["feature_id"], ["value"], "value_id", stored=True)
    return ranked.select("feature_id", "value", "value_id", "cnt")


def _long_lookup(rows: DataFrame, large: Sequence[int], dictionary: DataFrame, filled: int) -> DataFrame:
    """``(_row, _id…)``: the value ids of the features ``large`` for every row that has one.

    The cells of all these features go through one join on (feature, value), in which hot pairs are broadcast, and the ids
    found go back to their rows by number. That is one shuffle of cells and one of ids, however many features there are; the
    rows themselves move once, to meet their ids. ``filled`` is the number of cells with a value.
    """
    pair = F.struct("feature_id", "value").alias("_pair")
    cells = to_cells(rows, [f"_v{d}" for d in large], large, "_row").select("_row", "feature_id", pair)
    entries = dictionary.where(F.col("feature_id").isin(list(large))).select(pair, "value_id", "cnt")
    found = lookup(cells, "_pair", Keyed(entries, "_pair", "value_id", filled), "_id", False, F.col("_row"))
    own = [F.max(F.when(F.col("feature_id") == d, F.col("_id"))).alias(f"_id{d}") for d in large]
    return found.where(F.col("_id").isNotNull()).groupBy("_row").agg(*own)


def encode(
    data: DataFrame,
    columns: Sequence[str],
    dictionary: DataFrame,
    *keep: str,
    budget: int = BROADCAST_BYTES,
    row_id: str | None = None,
) -> DataFrame:
    """Replace each column by its value ids ``f0 …``, NULL where the cell is missing or the value unknown.

    ``dictionary`` is read once per broadcast feature, and once for all others, and should be stored. Where dictionaries are
    joined through a shuffle, a row needs a number that a retried task repeats: column ``row_id`` of ``data``, or else the
    input is stored first.
    """
    facts = dictionary.groupBy("feature_id").agg(
        F.sum(F.octet_length("value") + F.lit(_ENTRY_BYTES)).alias("bytes"), F.sum("cnt").alias("rows"), F.max("value_id").alias("last")
    )
    sizes = {r["feature_id"]: r for r in facts.collect()}  # one row per feature
    if too_large := [d for d, r in sizes.items() if r["last"] > _LAST_ID]:
        raise ValueError(f"feature {too_large[0]} has more values than 32-bit ids")
    small = split_budget({d: r["bytes"] for d, r in sizes.items()}, budget)
    large = sorted(sizes.keys() - small)
    values = [F.nullif(F.col(c), F.lit("")).alias(f"_v{d}") for d, c in enumerate(columns)]
    rows = data.select(*keep, *values, *([F.col(row_id).alias("_row")] if row_id else []))
    if large and not row_id:
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "raw-cells")
    out = rows
    for d in range(len(columns)):
        if d in small:
            entries = dictionary.where(F.col("feature_id") == d)
            out = lookup(out, f"_v{d}", Keyed(entries, "value", "value_id", sizes[d]["rows"]), f"_id{d}", True)
        elif d not in sizes:
            out = out.withColumn(f"_id{d}", F.lit(None))
    if large:
        filled = sum(sizes[d]["rows"] for d in large)
        out = out.join(_long_lookup(rows, large, dictionary, filled), "_row", "left")
    return out.select(*keep, *[F.col(f"_id{d}").cast("int").alias(f"f{d}") for d in range(len(columns))])


def index_features(
    raw: DataFrame,
    spec: DataFrame,
    min_cutoff: int = 1,
    max_cutoff: int | None = None,
    *,
    min_exclusive: bool = False,
    keep: Sequence[str] = (),
    budget: int = BROADCAST_BYTES,
    row_id: str | None = None,
    allow_empty: bool = False,
) -> Index:
    """Count, cut off, number and encode the raw columns named by ``spec``.

    A raw column without any value is an error unless ``allow_empty`` lets it go as one below the cut-off. ``row_id`` is
    one of ``keep``, a number taken at the scan (see ``encode``).
    Columns of ``raw`` in ``keep`` (a row id, say) are carried along; the others are matched to the spec by position.
    """
    data, columns, positions = project_features(raw, spec, *keep)
    counts = stage(value_counts(data, columns, positions), "value-counts")
    found = cardinality(counts)
    if not allow_empty and (empty := [r["name"] for r in empty_features(spec, found).collect()]):
        raise ValueError(f"no value in {', '.join(map(str, empty))}")
    sizes = within_cutoff(found, min_cutoff, max_cutoff, min_exclusive)
    fields = kept_fields(raw_fields(spec), sizes)
    rows = fields.collect()  # one row per column
    kept = raw.sparkSession.createDataFrame(rows, fields.schema)
    dictionary = stage(build_dictionary(counts, kept), "dictionary", by=["feature_id"])
    used = {r["pos"] for r in rows}
    kept_columns = [c for c, p in zip(columns, positions) if p in used]
    encoded = encode(data, kept_columns, dictionary, *keep, budget=budget, row_id=row_id)
    return Index(dictionary, kept, encoded, [f"f{d}" for d in range(len(kept_columns))])
