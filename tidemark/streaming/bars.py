"""Bars of a stream of events, late ones within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count per event type and window; a window is final once the watermark has passed it."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every), F.col("event_type").alias("ticker"))
    return rows.agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("value").alias("volume")).select("ticker", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
