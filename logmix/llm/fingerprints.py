"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Each word shingle is hashed once; the high bits choose one of ``BINS`` bins, whose least hash is kept. Empty bins are filled
by optimal densification: a bin probes others by a hash of (bin, attempt) until it meets a filled one; after ``PROBES``
attempts it takes the filled bin of the least hash of (bin, other), which is also an even choice among the filled ones. Of
each bin ``BITS`` low bits (of a hash with the bin) are stored, packed into 64-bit numbers. The likeness of two fingerprints is the share of
equal bins, corrected for those that agree by chance: ``(m - c) / (1 - c)`` with ``c = 2^-BITS``, held between 0 and 1.

Words are parted by 0x20 and 0x09-0x0D and lower-cased; a text with fewer words than a shingle is one shingle. A null text
counts as empty; a text without words has the empty fingerprint, which is like the empty one (1) and no other (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 32
_SHIFT = 64 - BINS.bit_length() + 1
_LOW = (1 << _SHIFT) - 1  # what a hash holds beside its bin
_PER_NUMBER = 64 // BITS
_NO_ID = 2**63 - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _shingles(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        several = F.transform(
            F.slice(h, 1, F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, SHINGLE)])
        )
        return F.when(F.size(h) >= SHINGLE, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return _let(hashes, rolled)


def _least_by_bin(hashes: Column) -> Column:
    """``BINS`` numbers in order of their bins: the least hash, or the bin's last number where it is empty."""
    last = F.array(*[F.lit((b << _SHIFT) + _LOW) for b in range(-BINS // 2, BINS // 2)])
    lead = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(a[i - 1], _SHIFT)))
    return _let(F.sort_array(F.concat(hashes, last)), lead)


def _filled(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW)


def _densified(least: Column) -> Column:
    def fill(v: Column, x: Column, i: Column) -> Column:
        def probe(t: int) -> Column:
            other = v[F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")]
            return F.when(_filled(other), other)

        rest = F.array_min(F.transform(v, lambda y, j: F.when(_filled(y), F.struct(F.xxhash64(j, i), y.alias("y")))))["y"]
        return F.when(_filled(x), x).otherwise(F.coalesce(*[probe(t) for t in range(PROBES)], rest))

    return _let(least, lambda v: F.transform(v, lambda x, i: fill(v, x, i)))


def _packed(values: Column) -> Column:
    """The low bits of ``_PER_NUMBER`` bins to a number.

    They are taken after a last hash with the bin, or else a value that fills several bins would agree in all by chance.
    """
    fold = lambda part: F.aggregate(
        part, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))
    )
    bits = F.transform(values, lambda x, i: F.xxhash64(x, i))
    return _let(bits, lambda v: F.array(*[fold(F.slice(v, k + 1, _PER_NUMBER)) for k in range(0, BINS, _PER_NUMBER)]))


def fingerprint(text: Column) -> Column:
    """The packed bits as ``array<long>``; empty for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x09-\\x0D ]+"), lambda w: w != "")
    packed = lambda h: F.when(F.size(h) > 0, _packed(_densified(_least_by_bin(h)))).otherwise(F.array().cast("array<long>"))
    return _let(_shingles(words), packed)


def as_text(packed: Column) -> Column:
    """A fingerprint in hexadecimal digits."""
    return F.concat_ws("", F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingle sets behind two fingerprints."""

    def unequal(x: Column, y: Column) -> Column:
        # Any differing bit of a bin is moved to the bin's lowest bit.
        folded, step = x.bitwiseXOR(y), 1
        while step < BITS:
            folded = folded.bitwiseOR(F.shiftrightunsigned(folded, step))
            step *= 2
        lowest = sum(1 << k for k in range(0, 64, BITS))
        return F.bit_count(folded.bitwiseAND(F.lit(lowest)))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-BITS
    estimate = ((1 - differing / BINS) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), estimate)).otherwise((F.size(a) == F.size(b)).cast("double"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last half is replaced by the first characters of another, as many or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def with_following(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Window]:
    """``(_key, _text, _next, _bucket, _extra, _tie)`` and the window in which the next row is the next document.

    Rows are dealt once, by ranges of the key; a copy of each range's first row stands at the end of the range before
    (``_extra`` = 1), and one of the very first row at the end of the last. Without a key a row comes last; rows with one
    key follow in the order of a hash of their texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    bounds = sorted(set(rows.select("_key").approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts) or []))
    bounds = [int(b) for b in bounds]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    rows = rows.withColumn("_bucket", place).withColumn("_tie", F.xxhash64("_text"))
    # One row per range.
    firsts = sorted((r["_bucket"], r["k"]) for r in rows.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())
    moves = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    at = spark.createDataFrame(moves, "_key long, _to int")
    copies = rows.join(F.broadcast(at), "_key").groupBy("_to", "_key").agg(F.min(F.struct("_tie", "_text")).alias("s"))
    extra = copies.select("_key", F.col("s._text").alias("_text"), F.col("_to").alias("_bucket"), F.col("s._tie").alias("_tie"))
    whole = rows.withColumn("_extra", F.lit(0)).unionByName(extra.withColumn("_extra", F.lit(1)))
    order = Window.partitionBy("_bucket").orderBy("_extra", "_key", "_tie")
    return whole.withColumn("_next", F.lead("_text").over(order)), order


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to the edited text and to the next row's."""
    whole, order = with_following(docs, key, text)
    edit = edited(F.col("_text"), F.col("_next"))
    made = whole.select(
        "_key", "_bucket", "_extra", "_tie",
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(edit.cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_text")).alias("own"),
        fingerprint(edit).alias("changed"),
    )
    beside = made.withColumn("following", F.lead("own").over(order)).where("_extra = 0")
    return beside.select(
        F.nullif(F.col("_key"), F.lit(_NO_ID)).alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
