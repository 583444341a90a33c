"""Queries of the stored index of document chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.checks import _CHUNKS
from tidemark.plans.sql import out
from tidemark.session import shared_folder
from tidemark.sources import document_index as index
from tidemark.sources.bars import table

QUERY = "the revenue of the year and its growth"
RENEWED = ("src1", "src3", "src4")  # sources that are ingested again, with their English documents alone


def _ingested(spark, d):
    """All documents by source, some sources twice."""
    path = f"{shared_folder(spark)}/document-index-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("ticker"), F.concat_ws(".", "source", "lang").alias("source_file"))
    index.ingest(docs, path)
    index.ingest(docs.filter(F.col("ticker").isin(*RENEWED) & (F.col("lang") == "en")), path)
    return index.load(spark, path)


def ingest(spark, d):
    """Documents, chunks and characters of each source that the index holds."""
    return _ingested(spark, d).groupBy("ticker").agg(
        F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"),
        F.max(F.md5(F.col("text").cast("binary"))).alias("digest"), F.countDistinct("version").alias("versions"),
    )


def nearest(spark, d):
    """Chunks by unit vectors of hashed words: how near each source comes to a query."""
    stored = _ingested(spark, d)
    near = stored.withColumn("s", index.dot(F.col("unit"), index.asked(spark, QUERY)))
    return out(near.groupBy("ticker").agg(F.max("s").alias("best"), F.avg("s").alias("mean"), F.max(index.dot(F.col("unit"), F.col("unit"))).alias("length")))


def answers(spark, d):
    """The ten best chunks for a query, by vectors and words."""
    best = index.search(_ingested(spark, d), QUERY)
    return out(best.select("chunk_id", "ticker", "score"))


_INDEX = f"""{_CHUNKS}, p AS (SELECT n.doc_id, regexp_replace(substring(t, begin_ + 1, end_ - begin_), '^\\s+|\\s+$', '', 'g') AS x
    FROM c JOIN n ON n.doc_id = c.doc_id WHERE idx >= 0),
  k AS (SELECT p.doc_id, x, coalesce(CASE WHEN lower(trim(source)) NOT IN ('', 'unknown', 'none') THEN source END, 'Unknown') AS ticker
    FROM p JOIN documents USING (doc_id) WHERE x <> '' AND (source NOT IN {RENEWED} OR lang = 'en'))"""
_BUCKETS = f"""list_transform(list_filter(regexp_split_to_array(lower({{}}), '[^a-zA-Z0-9_]+'), lambda w: w <> ''),
    lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {index.DIMENSIONS})"""
_COUNTS = f"list_transform(range({index.DIMENSIONS}), lambda i: CAST(len(list_filter({{}}, lambda b: b = i)) AS DOUBLE))"

QUERIES = {"search_ingest": ingest, "search_ingested_near": nearest, "search_ingested": answers}

ORACLE_SQL = {
    "search_ingest": f"""{_INDEX} SELECT ticker, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(length(x)) AS BIGINT) AS characters,
        max(md5(x)) AS digest, CAST(1 AS BIGINT) AS versions FROM k GROUP BY ticker""",
    "search_ingested_near": f"""{_INDEX}, b AS (SELECT ticker, {_BUCKETS.format('x')} AS b, (SELECT {_BUCKETS.format(f"'{QUERY}'")}) AS q FROM k),
        v AS (SELECT ticker, {_COUNTS.format('b')} AS v, {_COUNTS.format('q')} AS q FROM b),
        s AS (SELECT ticker, coalesce(list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 0), 0) AS s,
          CASE WHEN list_dot_product(v, v) > 0 THEN 1.0::DOUBLE ELSE 0 END AS one FROM v)
        SELECT ticker, round(max(s), 6) AS best, round(avg(s), 6) AS mean, max(one) AS length FROM s GROUP BY ticker""",
}
