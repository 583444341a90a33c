"""A stored index of document chunks, ingested ticker by ticker.

Chunks lie in folders by version and ticker. A manifest says which version of each ticker counts; it is written last, as
one file under the next number, so a run that fails or is repeated leaves one version of each ticker to readers, and a
ticker that is ingested again takes the place of its former chunks while others stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.utils import AnalysisException

from tidemark.operators.text import bm25, chunks, document_metadata, dot, hybrid

DIMENSIONS = 64  # of the embedding that needs no model
WORDS = 100_000  # whose places are kept at once
UNKNOWN = ("", "unknown", "none")

CHUNKS = "chunk_id string, doc_id long, chunk_index int, source_file string, text string, unit array<double>, version string, ticker string"
MANIFEST = "ticker string, version string, chunks long, number long"


def _hashed(texts: pa.Array) -> pa.Array:
    places: dict[str, int] = {}
    # one block of numbers, a row for each text
    rows = np.zeros((len(texts), DIMENSIONS))
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9_]+", (text.as_py() or "").lower(), re.ASCII)
        for w in words:
            if w not in places:
                if len(places) >= WORDS:
                    places.clear()
                places[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMENSIONS
            rows[i, places[w]] += 1
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(rows.ravel()))


def hashed(text: Column) -> Column:
    """Counts of words by hash: an embedding without a model, in Arrow batches."""
    return F.arrow_udf(_hashed, ArrayType(DoubleType()))(text)


def unit(vector: Column) -> Column:
    """At length 1; as it is if its length is 0. The length is bound once: within the inner function it would be summed again for
    each component."""
    at = lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector)
    return F.get(F.transform(F.array(F.sqrt(dot(vector, vector))), at), 0)


def chunked(
    docs: DataFrame, embed: Callable[[Column], Column] = hashed, *, ticker: str | None = None, overwrite: bool = True, size: int = 800, overlap: int = 150
) -> DataFrame:
    """Chunks of documents (doc_id, text, source_file and perhaps ticker) with their ticker and unit vector.

    A document's ticker is its own, or what its file name tells; with `ticker` given, all documents get it, or only those
    whose own is unknown if not `overwrite`. Texts without words have no chunks. doc_ids are taken to be unique.
    """
    own = F.col("ticker") if "ticker" in docs.columns else document_metadata(F.col("source_file"))["ticker"]
    known = F.when(~F.lower(F.trim(own)).isin(*UNKNOWN), own)
    tag = F.coalesce(known, F.lit("Unknown")) if ticker is None else F.lit(ticker) if overwrite else F.coalesce(known, F.lit(ticker))
    # the row goes with its text through the cut, so that documents are joined with nothing
    tagged = docs.select("doc_id", "source_file", tag.alias("ticker"), "text")
    rows = chunks(tagged, size=size, overlap=overlap, keep=("source_file", "ticker")).withColumn("chunk_id", F.concat_ws("_", "doc_id", "chunk_index"))
    rows = rows.select("chunk_id", "doc_id", "chunk_index", "source_file", F.col("chunk").alias("text"), embed(F.col("chunk")).alias("_vector"), "ticker")
    return rows.withColumn("unit", unit(F.col("_vector"))).drop("_vector")


def asked(spark: SparkSession, query: str, embed: Callable[[Column], Column] = hashed) -> Column:
    """The unit vector of a query, which is embedded once, as a literal."""
    vector = spark.range(1).select(embed(F.lit(query)).alias("v")).select(unit(F.col("v")).alias("u")).first().u
    return F.array(*map(F.lit, vector))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST of the last run that ended: one row for each ticker."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    last = rows.agg(F.max("number")).first()[0]
    return rows.filter(F.col("number") == last) if last is not None else rows


def ingest(docs: DataFrame, path: str, embed: Callable[[Column], Column] = hashed, **how) -> DataFrame:
    """Chunks, tags and stores documents; each ticker that they have is replaced, others stay. The new manifest.

    No chunks at all is refused. Two runs at once would each miss the other's tickers: one run at a time.
    """
    spark = docs.sparkSession
    version = uuid.uuid4().hex
    rows = chunked(docs, embed, **how)
    rows.repartition("ticker", F.pmod("doc_id", F.lit(64))).write.partitionBy("ticker").parquet(f"{path}/chunks/version={version}")
    written = _stored(spark, path).filter(F.col("version") == version).groupBy("ticker").agg(F.count(F.lit(1)).alias("chunks"))
    before = manifest(spark, path)
    number = (before.agg(F.max("number")).first()[0] or 0) + 1
    new = written.select("ticker", F.lit(version).alias("version"), "chunks")
    if new.isEmpty():
        raise ValueError("no text chunks were produced")
    kept = before.join(new.select("ticker"), "ticker", "left_anti").select("ticker", "version", "chunks")
    # one row for each ticker, in one file: it is there as a whole or not at all
    kept.unionByName(new).coalesce(1).write.parquet(f"{path}/manifest/number={number}")
    return manifest(spark, path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def load(spark: SparkSession, path: str) -> DataFrame:
    """CHUNKS of the versions that count. Scans of one ticker read its folders alone."""
    return _stored(spark, path).join(manifest(spark, path).select("ticker", "version"), ["ticker", "version"], "left_semi")


def search(stored: DataFrame, query: str, *, k: int = 10, ticker: str | None = None, embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """The k best chunks (chunk_id, score, ticker, text) by unit vectors and words together, of a ticker's chunks if it has any."""
    if ticker is not None and not stored.filter(F.col("ticker") == ticker).isEmpty():
        stored = stored.filter(F.col("ticker") == ticker)
    vector = asked(stored.sparkSession, query, embed)
    near = stored.select(F.col("chunk_id").alias("key"), dot(F.col("unit"), vector).alias("s"))
    words = bm25(stored, query, key="chunk_id").select(F.col("chunk_id").alias("key"), F.col("bm25").alias("w"))
    best = hybrid(near, words, k)
    out = best.join(stored.select(F.col("chunk_id").alias("key"), "ticker", "text"), "key")
    return out.select(F.col("key").alias("chunk_id"), "score", "ticker", "text").orderBy(F.desc(F.round("score", 9)), "chunk_id")
