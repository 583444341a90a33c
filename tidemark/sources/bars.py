"""Price bars and related series, derived from the warehouse tables.

A bar has ticker, date, open, high, low, close, volume. Bars are sums over rows of one scan: columns are pruned to those
used, partial sums run before the shuffle, and the result has one row per ticker and period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per return flag and ship week, of line prices: the long history for windows. It opens at the price of the first line."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.min_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"),
    )


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per market segment and order day; first and last order by key."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


def tick_bars(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """One bar per event type and hour or day of the event stream."""
    events = table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    return events.groupBy(F.col("event_type").alias("ticker"), F.date_trunc(every, "ts").alias("ts")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def benchmark(bars: DataFrame) -> DataFrame:
    """The mean close of all tickers on each date."""
    return bars.groupBy("date").agg(F.avg("close").alias("bench_close"))


def standardized(bars: DataFrame) -> DataFrame:
    """The seven bar columns, without rows that have no close."""
    return bars.select(*BAR_COLUMNS).filter(F.col("close").isNotNull())


def history(bars: DataFrame, tickers: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some tickers between two dates, ends included; both filters reach the scan of stored bars."""
    out = bars.filter(F.col("ticker").isin(tickers))
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    return out.filter(F.col("date") <= F.lit(end).cast("date")) if end else out


def latest(bars: DataFrame, ticker: str, n: int = 100) -> DataFrame:
    """The n latest bars of one ticker."""
    return bars.filter(F.col("ticker") == ticker).orderBy(F.desc("date")).limit(n)
