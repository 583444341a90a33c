"""Document fingerprints: a threshold-scaled sketch of word shingles. DataFrame functions only.

A sketch holds every shingle hash under a fixed fraction of the hash range. The hashes under the fraction are the same sample in
every document: sketches of parts merge by union, and shares of very unequal documents can be estimated. A text without a hash
under the fraction keeps its least one instead, so that it has a fingerprint; that one is told by lying beyond the fraction, and
neither containment nor a merge with other hashes counts it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cuts_below, documents, tasks_for_bytes

WORDS = 5
SCALE = 8  # one of so many hashes is kept
RANGE_BYTES = 4 << 20  # text of a range of doc_id, in which neighbours are looked up
LEAST_RANGES, MOST_RANGES = 512, 1 << 14  # bounds what is broadcast; beyond them a range grows and is sorted on disk
BLANK = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, *, words: int = WORDS, scale: int = SCALE) -> Column:
    """array<long>, sorted: the kept hashes of the distinct shingles of `words` words (lower-cased, cut at ASCII white
    space). With fewer words the whole sequence is the shingle; a null text or one without words has none."""
    each = F.filter(F.split(F.lower(text), BLANK, -1), lambda w: w != "")
    hashes = F.transform(each, lambda w: F.xxhash64(w))
    # lambdas over one-element arrays, so that split and hashes are computed once
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def shingles(h: Column) -> Column:
        runs = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        return F.when(F.size(h) >= words, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return F.coalesce(once(once(hashes, shingles), lambda s: _kept(s, scale)), F.array().cast("array<long>"))


def _limit(scale: int) -> int:
    """xxhash64 is signed: the end of the lowest part of its range."""
    return -(1 << 63) + (1 << 64) // scale


def _under(hashes: Column, scale: int) -> Column:
    return F.filter(hashes, lambda x: x < _limit(scale))


def _kept(hashes: Column, scale: int) -> Column:
    """Of all hashes of a text, or of the sketches of its parts, those of its sketch: different ones, sorted."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    least = F.filter(F.array(F.array_min(hashes)), lambda x: x.isNotNull())
    return F.array_sort(once(F.array_distinct(_under(hashes, scale)), lambda u: F.when(F.size(u) > 0, u).otherwise(least)))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of intersection over union, 0 to 1; two empty sketches are alike."""
    common, both = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(common / (both - common))


def containment(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """Estimate of the share of a's shingles that b has too, 0 to 1; 1 where a has none; null where a has none under the fraction."""
    own = _under(a, scale)
    return F.when(F.size(a) == 0, 1.0).when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own))


def merged(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """The sketch of all shingles of two sketches: the same as that of the texts' shingles together."""
    return _kept(F.concat(a, b), scale)


def _with_ends(docs: DataFrame, ranges: int | None) -> DataFrame:
    """docs (doc_id, text) with the number of their range of doc_id, counted from the largest ids down; the first row of
    each range is there once more (copy), for the end of the range before it, and the very first for the end of the last."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(MOST_RANGES, max(LEAST_RANGES, tasks_for_bytes(docs, "text", RANGE_BYTES)))
    cuts = docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("c")).first().c or []
    cuts = sorted({c for c in cuts if c is not None})
    place = F.lit(len(cuts)) - cuts_below(cuts, "doc_id")
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(place).cast("int"))
    # at most `ranges` rows
    firsts = dealt.groupBy("range").agg(F.max("doc_id").alias("first_id")).orderBy("range").collect()
    homes = pa.table({"first_id": pa.array([r.first_id for r in firsts], pa.int64()), "home": pa.array([firsts[i - 1].range for i in range(len(firsts))], pa.int32())})
    copies = docs.join(F.broadcast(spark.createDataFrame(homes)), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("doc_id", "home").agg(F.min("text").alias("text"))
    copies = copies.select("doc_id", "text", F.col("home").alias("range"), F.lit(True).alias("copy"))
    return dealt.withColumn("copy", F.lit(False)).unionByName(copies)


def fingerprints(docs: DataFrame, *, words: int = WORDS, scale: int = SCALE, ranges: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, share_edited.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's. share_edited estimates the share of the text's shingles that the edited one keeps, and is null
    where none of its hashes is under the fraction. Null texts count as
    empty, repeated rows follow each other, and an only row follows itself. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    window = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    rows = _with_ends(narrow, ranges).withColumn("own", sketch(F.col("text"), words=words, scale=scale))
    rows = rows.withColumns({"next_text": F.lead("text").over(window), "next": F.lead("own").over(window)}).filter("not copy")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited_text", edited).withColumn("edited", sketch(F.col("edited_text"), words=words, scale=scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        containment(F.col("own"), F.col("edited"), scale=scale).alias("share_edited"),
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
