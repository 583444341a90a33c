"""Pieces of the DuckDB SQL that checks queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEKLY = """bars AS (
  SELECT l_returnflag AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low, avg(l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
)"""
LAGGED = f"""{WEEKLY}, r AS (
  SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)
)"""
BENCH = "bench AS (SELECT date, avg(close) AS bench_close FROM bars GROUP BY date)"
OVER = "OVER (PARTITION BY ticker ORDER BY date)"


#: How long histories are cut here: seven years of weekly bars make several blocks of 128 rows, numbered in periods of two years.
BLOCKS = {"size": 128, "days": 731}


def rolling(f: str, column: str, n: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({column}) {over} >= {n if least is None else least} THEN {f}({column}) {over} END)"


def rounded(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """A query's result: doubles rounded, all else as it is."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
