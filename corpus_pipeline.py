"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back by the next.

1. toxicity: a clause grammar weighed on the labelled rows (all but the held-out quarter); documents that score 0.3 or more go;
2. near duplicates: word 5-shingles with a similarity of 0.8 or more; the document with the least id of each group stays;
3. repeated passages: bytes that a 50-byte string covers which also starts in an earlier document go from the texts;
   a character of which only a part remains goes too, and n_chars follows;
4. mixing: all documents stay, in the order of an earliest-deadline-first schedule of their sources;
5. SentencePiece: the documents' columns, the place in the schedule (``position``, from 0 without gaps), their ids, and the
   number of these. The place is read off the mixing stage's files, in the order of their part numbers and rows, since a scan
   deals files by size. Rows of the result are in no order; sort by ``position`` for the schedule's.

A null text counts as empty throughout and is empty after stage 3. Repeated rows (same id and text) stay together or go
together in stages 1 and 2. Columns other than those of ``documents`` are dropped; an empty table gives no rows.

The stages set the session's bytes of an Arrow batch to ``BATCH_BYTES``, unless the caller has set them: a batch of Spark's 10,000
rows holds up to 64 MB of texts, and a task holds it several times over, in the JVM and in its worker. The setting stays, since a
stage's result runs later.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmix.llm import minhash_dedup, mixing, sentence_pieces, suffix_dedup, toxicity
from logmix.llm.queries import fold
from logmix.llm.shipping import shipped
from logmix.storage import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ORACLE_SQL: str | None = None


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with the bytes of an Arrow batch bounded first; the first argument is the session."""

    @wraps(stage)
    def run(spark: SparkSession, *rest) -> DataFrame:
        if spark.conf.get(_BATCH_SETTING, None) is None:
            spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, *rest)

    return run


@bounded
@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    model = toxicity.train(docs, labels, "doc_id", "text")
    scored = toxicity.score(docs, model, COLUMNS)
    return scored.where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


@bounded
@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(docs, "doc_id", "text", minhash_dedup.Settings(shingle=5, percent=80))
    # An id may stand in several rows; a document stays if one of its rows is kept, and rows without an id are one.
    kept = found.where("kept").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_kept")).distinct()
    return docs.join(kept, F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("_kept"), "left_semi").select(*COLUMNS)


@bounded
@shipped
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, "doc_id", "text", others, as_text=True)
    return cut.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


@bounded
@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mix(docs, COLUMNS)).select(*COLUMNS)


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, read from the files of one ordered table, and ``position``, the place of a row in that table."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("n")).collect()
    # Part numbers have five digits or more.
    files.sort(key=lambda f: (int(re.match(r"part-(\d+)", f["_file"])[1]), f["_file"]))
    first = accumulate((f["n"] for f in files), initial=0)
    offsets = spark.createDataFrame([(f["_file"], n) for f, n in zip(files, first)], "_file string, _first long")
    return rows.join(F.broadcast(offsets), "_file").select(*docs.columns, (F.col("_first") + F.col("_row")).alias("position"))


@bounded
@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(numbered(spark, docs), "text", [*COLUMNS, "position"], model)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
