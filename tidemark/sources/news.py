"""Headlines made of orders: invented sentences that hold the words that text operators look for, chosen by the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINES = (
    "Record profit beats guidance for the quarter",
    "Regulator opens antitrust probe after fraud concerns at ACME",
    "Acquisition deal and buyback announced by ACME",
    "New product launch wins customer contract",
    "Factory shortage delays shipment and inventory",
    "Analyst upgrade lifts the price target",
    "Inflation and tariff fears hit the market",
    "Annual meeting held in spring",
    "Default and bankruptcy warning as losses widen",
    "Strong demand and margin improvement in retail stores",
    "Debt and finance cost rise with capital expenditure",
    "Weak cash flow under regulatory compliance costs",
    "Strong cash flow growth and deleveraging",
    "Oil to chemicals refining margins decline",
    "Cloud consulting momentum continues",
    "Retail banking treasury sees risk in weak demand",
    "Jio broadband arpu growth supports expansion",
    "Market leader with a competitive advantage and tailwinds",
    "Headwinds from competition and input cost",
    "ACME revenue outlook unchanged",
)
TICKERS = ("ACME", "OMEGA.NS", "DELTA")


def _pick(words, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))


def headlines(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """(news_id, customer, ticker, related, text): one row per order, of two sentences; some are tagged with tickers.

    `place` names a further column, that of the file and the row in it where the order is stored.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat_ws(". ", _pick(HEADLINES, k), _pick(HEADLINES, k * 7 + c))
    related = F.when(k % 5 == 0, F.array(F.lit("acme"), _pick(TICKERS, c))).when(k % 5 == 1, F.array(F.lit("OTHER"))).otherwise(F.array().cast("array<string>"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stored = [F.struct("_metadata.file_path", "_metadata.row_index").alias(place)] if place else []
    return orders.select(k.alias("news_id"), c.alias("customer"), _pick(TICKERS, c).alias("ticker"), related.alias("related"), text.alias("text"), *stored)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: headlines() in SQL.
NEWS = f"""news AS (SELECT o_orderkey AS news_id, o_custkey AS customer, list_extract({_list(TICKERS)}, 1 + o_custkey % {len(TICKERS)}) AS ticker,
  CASE WHEN o_orderkey % 5 = 0 THEN ['acme', list_extract({_list(TICKERS)}, 1 + o_custkey % {len(TICKERS)})] WHEN o_orderkey % 5 = 1 THEN ['OTHER'] ELSE CAST([] AS VARCHAR[]) END AS related,
  list_extract({_list(HEADLINES)}, 1 + o_orderkey % {len(HEADLINES)}) || '. ' || list_extract({_list(HEADLINES)}, 1 + (o_orderkey * 7 + o_custkey) % {len(HEADLINES)}) AS text FROM orders)"""
