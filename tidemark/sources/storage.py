"""Stored bars and records: Parquet and CSV by ticker, typed on the way in."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BARS = "date date, open double, high double, low double, close double, volume double, ticker string"


def save_bars(bars: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per ticker: a scan of one ticker reads its folder alone."""
    writer = bars.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode(mode).partitionBy("ticker")
    writer.option("header", True).format(kind).save(path)


def load_bars(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(BARS).option("header", True).format(kind).load(path)


def load_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(source_file, text) of whole text files in a folder and those under it."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, bytes, modified) of the data files in a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select(name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.filter(F.col("kind").isin("csv", "parquet", "json", "jsonl", "feather"))


FACTORS = (
    "date date, ticker string, overall_sentiment_score double, risk_score double, growth_score double, debt_risk_score double, capex_intensity_score double, "
    "margin_pressure_score double, cash_flow_quality_score double, management_tone_score double, regulatory_risk_score double"
)


def save_factors(factors: DataFrame, path: str, mode: str = "append") -> None:
    factors.write.mode(mode).option("header", True).csv(path)


def load_factors(spark: SparkSession, path: str) -> DataFrame:
    """Stored factor records, typed; dates that are none are null."""
    return spark.read.schema(FACTORS).option("header", True).csv(path)


def cached(spark: SparkSession, folder: str, key: str, ttl: float, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gave less than `ttl` seconds ago under this key, else what it gives now, kept as Parquet in a folder that all
    executors share. Each result is a folder of its own, named by its time."""
    base = f"{folder.rstrip('/')}/key={key}"
    try:
        times = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base).select(F.regexp_extract("path", "/at-([0-9]+)/", 1).cast("long").alias("at"))
        last = times.agg(F.max("at")).first()[0]
    except AnalysisException:
        last = None
    now = int(time.time() * 1000)
    if last is None or now - last >= ttl * 1000:
        last = now
        make().write.parquet(f"{base}/at-{now}")
    return spark.read.parquet(f"{base}/at-{last}")
