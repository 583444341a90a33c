"""Exact length histogram: documents by encoded length, with suffix sums for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, slices, written
from .tokenize import SLICE_BYTES, default_path, encoder

BAND = 1024  # lengths per band of the two-level suffix sums


def token_lengths(docs: DataFrame, tokenizer: str, *, text: str = "text", end_ids: int = 0) -> DataFrame:
    """One row per document: n_tokens. Null and empty texts have end_ids tokens; repeated rows count once each, ids (null ones
    too) and other columns play no part, and a long text is encoded as a whole. An empty table gives no rows."""

    def lengths(batches):
        table = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                n = np.diff(table.encode(part.column(0))[1]) + end_ids
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs, and for a context limit of n_tokens: docs_longer, tokens_total (of all documents),
    tokens_kept (documents cut at the limit), tokens_lost, and share_within (documents that fit, as a share).

    Partial sums run before the shuffle. Suffix sums go over the distinct lengths only, in bands of BAND
    lengths: within a band by a window, across bands from one row per band. An empty table gives no rows.
    """
    # written, as it is read twice and the corpus is to be encoded once
    histogram = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")
    histogram = histogram.withColumn("band", F.floor(F.col("n_tokens") / BAND)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = histogram.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "band",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = histogram.withColumns({
        "docs_above": F.coalesce(F.sum("n_docs").over(within), F.lit(0)),
        "tokens_above": F.coalesce(F.sum("tokens").over(within), F.lit(0)),
    }).join(bands, "band")
    longer = F.col("docs_above") + F.col("docs_after")
    lost = F.col("tokens_above") + F.col("tokens_after") - longer * F.col("n_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        longer.alias("docs_longer"),
        "tokens_total",
        (F.col("tokens_total") - lost).alias("tokens_kept"),
        lost.alias("tokens_lost"),
        (1 - longer / F.col("all_docs")).alias("share_within"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents does not exceed."""
    return histogram.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer, tokens_kept, tokens_lost for any limits, those that no document has as well; one pass over the histogram."""
    n, d, limit = F.col("n_tokens"), F.col("n_docs"), F.col("context_limit")
    rows = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"))
    return rows.groupBy("context_limit").agg(
        F.sum(F.when(n > limit, d).otherwise(0)).alias("docs_longer"), F.sum(d * F.least(n, limit)).alias("tokens_kept"), F.sum(d * (n - F.least(n, limit))).alias("tokens_lost")
    )


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(documents(spark, sf_dir), default_path(), end_ids=1))
