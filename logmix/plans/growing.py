"""An index that grows: values of added rows are merged into what was counted before, without rereading older rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.operators.cells import empty_features, value_counts, within_cutoff
from logmix.operators.lookup import BROADCAST_BYTES
from logmix.operators.ranking import rank_ordered
from logmix.plans.indexing import encode, kept_fields, project_features
from logmix.sources.text import raw_fields
from logmix.storage import stage


@dataclass(frozen=True)
class GrowingIndex:
    """``values (feature_id, value, cnt, value_id)``: all values so far, by raw position, with ids where the feature is kept;
    ``kept (feature_id, pos, name, flag, family)`` as in ``Index``."""

    values: DataFrame
    kept: DataFrame

    def dictionary(self) -> DataFrame:
        """``(feature_id, value, value_id, cnt)`` of the kept features, as in ``Index``."""
        ids = self.kept.select(F.col("feature_id").alias("_new"), "pos")
        known = self.values.join(F.broadcast(ids), F.col("feature_id") == F.col("pos"))  # one row per column
        return known.select(F.col("_new").alias("feature_id"), "value", "value_id", "cnt")


def grow_index(
    index: GrowingIndex | None,
    added: DataFrame,
    spec: DataFrame,
    min_cutoff: int = 1,
    max_cutoff: int | None = None,
    *,
    min_exclusive: bool = False,
    keep: Sequence[str] = (),
    allow_empty: bool = False,
) -> GrowingIndex:
    """``index`` with the rows of ``added`` counted in; None starts a new one.

    Only ``added`` is read; older rows stand in by their counts. The result is that of an index over all rows at once. Values are
    numbered anew only in features that got new values or were not kept before: elsewhere the string order is the same, so
    the ids are. ``spec`` and the columns of ``added`` are those of the earlier calls; ``keep`` names columns that are no features.
    A raw column without any value so far is an error unless ``allow_empty`` is set.
    """
    data, columns, positions = project_features(added, spec, *keep)
    new = value_counts(data, columns, positions).select("feature_id", "value", "cnt", F.lit(None).cast("bigint").alias("value_id"))
    both = new if index is None else index.values.select(new.columns).unionByName(new)
    merged = stage(both.groupBy("feature_id", "value").agg(F.sum("cnt").alias("cnt"), F.max("value_id").alias("value_id")), "values")

    facts = merged.groupBy("feature_id").agg(
        F.count("*").alias("v_size"), F.count_if(F.col("value_id").isNull()).alias("unnumbered")
    )
    rows = facts.collect()  # one row per column
    spark = added.sparkSession
    sizes = spark.createDataFrame(rows, facts.schema)
    if not allow_empty and (empty := [r["name"] for r in empty_features(spec, sizes).collect()]):
        raise ValueError(f"no value in {', '.join(map(str, empty))}")
    fields = kept_fields(raw_fields(spec), within_cutoff(sizes, min_cutoff, max_cutoff, min_exclusive))
    kept = fields.collect()  # one row per column
    used = {r["pos"] for r in kept}
    again = [r["feature_id"] for r in rows if r["feature_id"] in used and r["unnumbered"]]
    same = [p for p in used if p not in again]

    still = merged.withColumn("value_id", F.when(F.col("feature_id").isin(same), F.col("value_id")))
    values = still.where(~F.col("feature_id").isin(again))
    if again:
        open_features = merged.where(F.col("feature_id").isin(again)).drop("value_id")
        ranked = rank_ordered(open_features, ["feature_id"], ["value"], "value_id", stored=True)
        values = values.unionByName(ranked.select(values.columns))
    return GrowingIndex(stage(values, "grown-values"), spark.createDataFrame(kept, fields.schema))


def moved_ids(before: GrowingIndex, after: GrowingIndex) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """``(pos, value_id, new_id, cnt)`` of features whose ids changed, and the columns (by position) before and after.

    Ids changed where a feature has more values than before. ``cnt`` counts the older rows. Nothing but values is joined.
    """
    of = lambda index: {r["pos"]: r["feature_id"] for r in index.kept.collect()}  # noqa: E731  one row per column
    count = lambda index: {r[0]: r[1] for r in index.values.groupBy("feature_id").count().collect()}
    columns, new_columns = of(before), of(after)
    old_sizes, sizes = count(before), count(after)
    changed = [p for p in columns if p in new_columns and old_sizes[p] != sizes[p]]
    numbered = after.values.where(F.col("feature_id").isin(changed)).select("feature_id", "value", F.col("value_id").alias("new_id"))
    known = before.values.where(F.col("feature_id").isin(changed)).join(numbered, ["feature_id", "value"])
    return known.select(F.col("feature_id").alias("pos"), "value_id", "new_id", "cnt"), columns, new_columns


def recode(
    encoded: DataFrame,
    before: GrowingIndex,
    after: GrowingIndex,
    *keep: str,
    budget: int = BROADCAST_BYTES,
    row_id: str | None = None,
) -> DataFrame:
    """Rows encoded as ``f0 …`` under ``before``, with the columns and ids of ``after``, any number of growths later.

    Columns whose ids did not change are carried along, the others are looked up as in ``encode`` (``budget``, ``row_id``).
    Features that are no longer kept are left out. One that was not kept before has no ids in these rows: that is an error,
    and they must be encoded from the raw rows. An id that ``before`` does not hold becomes missing.
    """
    moves, columns, new_columns = moved_ids(before, after)
    if entered := sorted(p for p in new_columns if p not in columns):
        raise ValueError(f"features at {entered} were not kept before; encode the raw rows")
    moves = stage(moves, "moved-ids")
    changed = sorted(r["pos"] for r in moves.select("pos").distinct().collect())  # one row per column
    order = sorted(new_columns, key=new_columns.get)
    same = [F.col(f"f{columns[p]}").alias(f"_same{p}") for p in order if p not in changed]
    rows = encoded.select(*keep, *same, *[F.col(f"f{columns[p]}").cast("string").alias(f"_old{p}") for p in changed])
    place = F.create_map(*[F.lit(x) for pair in zip(changed, range(len(changed))) for x in pair]) if changed else None
    if changed:
        table = moves.select(
            place[F.col("pos")].alias("feature_id"), F.col("value_id").cast("string").alias("value"),
            F.col("new_id").alias("value_id"), "cnt",
        )
        carried = [*keep, *[f"_same{p}" for p in order if p not in changed]]
        rows = encode(rows, [f"_old{p}" for p in changed], table, *carried, budget=budget, row_id=row_id)
    found = {p: f"f{i}" for i, p in enumerate(changed)}
    return rows.select(*keep, *[F.col(found.get(p, f"_same{p}")).alias(f"f{new_columns[p]}") for p in order])
