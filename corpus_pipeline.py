"""A training corpus from raw documents: toxic ones out, one of each near-duplicate group, secrets masked, sources mixed, packed.

Every stage takes and (but for the last) returns the columns of documents, any others too, whatever their names. Null and empty
texts pass all stages: they score as texts without terms, are near duplicates of nothing, hold no secrets, take no bytes of a
source, and are packed as their end id. Rows with a null doc_id are kept. Rows that repeat a doc_id share its group: all of
them stay or go. A null source is one of its own. Long texts are read as a whole. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.mixing import first_slots, in_mixed_order
from tidemark.llm.near_duplicates import without_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.secrets import redacted
from tidemark.llm.shared import documents, written
from tidemark.llm.tokenize import default_path
from tidemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the machine learns from the labels of documents that are still here."""
    return without_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by 0.8 of their five-word shingles: that of least doc_id."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars counted again; every document stays."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; rows are put in the order in which sources interleave."""
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in windows of 4096, whose numbers follow the mixed order.

    Parquet keeps no order between files, so slots are computed again from the rows as they are read.
    """
    return pack(docs, default_path(), slots=first_slots(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Trained scores and hashes cannot be had in SQL; the stages are tested by themselves and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
