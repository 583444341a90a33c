"""Queries of the rule engine: conditions, sizing, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.plans.sql import OVER, WEEKLY, out, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import weekly_bars

PRICE = {"kind": "PRICE"}
ENTRY = [{"left": {"kind": "RSI", "period": 14}, "op": "<", "right": {"kind": "CONST", "value": 55}}, {"left": PRICE, "op": "<=", "right": {"kind": "SMA", "period": 10}}]
LEAVE = [{"left": PRICE, "op": "CROSS_UP", "right": {"kind": "BB", "period": 20, "band": "UPPER"}}, {"left": {"kind": "MOMENTUM", "period": 5}, "op": ">", "right": {"kind": "CONST", "value": 4}}]
OTHERS = [{"left": PRICE, "op": "CROSS_DN", "right": {"kind": "BB", "period": 20, "band": "LOWER"}}, {"left": PRICE, "op": ">=", "right": {"kind": "BB", "period": 20, "band": "MID"}}, {"left": PRICE, "op": "==", "right": PRICE}]
SIZING, TAKE, STOP = {"kind": "VOL_TARGET", "target": 0.5}, 0.06, 0.05


def conditions(spark, d):
    every = ENTRY + LEAVE + OTHERS
    return B.rules(weekly_bars(spark, d), every).select("ticker", "date", *[F.col(f"c{i}") for i in range(len(every))])


def _engine(spark, d):
    return B.engine(weekly_bars(spark, d), ENTRY, LEAVE, SIZING, TAKE, STOP)


def engine(spark, d):
    return out(_engine(spark, d).select("ticker", "date", "held", "scale", "strategy_return", "equity"))


def engine_statistics(spark, d):
    return out(B.engine_statistics(_engine(spark, d)))


def sizings(spark, d):
    """Final worth of the same strategy under each kind of sizing."""
    rows = None
    for sizing in (SIZING, {"kind": "FIXED", "percent": 50}, {"kind": "KELLY", "fraction": 0.3}):
        one = B.engine(weekly_bars(spark, d), ENTRY, LEAVE, sizing, TAKE, STOP).groupBy("ticker").agg(F.lit(sizing["kind"]).alias("sizing"), F.max_by("equity", "date").alias("equity"))
        rows = one if rows is None else rows.unionByName(one)
    return out(rows)


_FLAGS = f"""{WEEKLY}, g AS (SELECT *, greatest(close - lag(close) {OVER}, 0.0) AS up, greatest(lag(close) {OVER} - close, 0.0) AS down, close / lag(close) {OVER} - 1 AS r, close / lag(close, 5) {OVER} - 1 AS m5, row_number() {OVER} AS i FROM bars),
  g2 AS (SELECT ticker, date, close, r, m5, i, CASE WHEN i > 1 THEN up END AS up, CASE WHEN i > 1 THEN down END AS down FROM g),
  s AS (SELECT *, {rolling('sum', 'up', 14)} AS su, {rolling('sum', 'down', 14)} AS sd, {rolling('avg', 'close', 10)} AS m10, {rolling('avg', 'close', 20)} AS mid, {rolling('stddev_pop', 'close', 20)} AS dev FROM g2),
  b AS (SELECT *, CASE WHEN su + sd = 0 THEN 50 ELSE 100 - 100 / (1 + su / greatest(sd, 1e-9)) END AS rsi, mid + 2 * dev AS hi, mid - 2 * dev AS lo FROM s),
  f AS (SELECT *, coalesce(rsi < 55, false) AS c0, coalesce(close <= m10, false) AS c1, coalesce(lag(close) {OVER} <= lag(hi) {OVER} AND close > hi, false) AS c2, coalesce(m5 * 100 > 4, false) AS c3,
    coalesce(lag(close) {OVER} >= lag(lo) {OVER} AND close < lo, false) AS c4, coalesce(close >= mid, false) AS c5, true AS c6 FROM b)"""
_ENGINE = f"""WITH RECURSIVE {_FLAGS}, p AS (SELECT ticker, 1::BIGINT AS i, false AS inn, 0.0::DOUBLE AS px, 0 AS held, false AS gone, NULL::DOUBLE AS entry FROM f WHERE i = 1
    UNION ALL SELECT f.ticker, f.i, CASE WHEN inn THEN NOT (c2 OR c3 OR close / px - 1 >= {TAKE} OR close / px - 1 <= -{STOP}) ELSE c0 AND c1 END, CASE WHEN NOT inn AND c0 AND c1 THEN close ELSE px END, CAST(inn AS INTEGER),
      inn AND (c2 OR c3 OR close / px - 1 >= {TAKE} OR close / px - 1 <= -{STOP}), CASE WHEN inn THEN px END FROM p JOIN f ON f.ticker = p.ticker AND f.i = p.i + 1),
  h AS (SELECT f.ticker, f.date, f.close, f.i, coalesce(f.r, 0) AS r, held, gone, entry FROM f JOIN p ON p.ticker = f.ticker AND p.i = f.i),
  v AS (SELECT *, CASE WHEN i > 21 THEN least(2, {SIZING['target']} / greatest(0.05, sqrt(avg(r * r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) * sqrt(252))) ELSE 1 END AS scale FROM h),
  q AS (SELECT *, held * r * scale AS sr FROM v), e AS (SELECT *, product(1 + sr) {OVER} AS equity FROM q)"""

QUERIES = {"strategy_conditions": conditions, "strategy_engine": engine, "strategy_engine_statistics": engine_statistics, "strategy_sizings": sizings}

ORACLE_SQL = {
    "strategy_conditions": f"WITH {_FLAGS} SELECT ticker, date, c0, c1, c2, c3, c4, c5, c6 FROM f",
    "strategy_engine": f"{_ENGINE} SELECT ticker, date, held, {sql(scale='scale::DOUBLE', strategy_return='sr', equity='equity')} FROM e",
    "strategy_engine_statistics": f"""{_ENGINE}, d AS (SELECT *, equity / max(equity) {OVER} - 1 AS dd, CASE WHEN held = 1 AND (gone OR date = max(date) OVER (PARTITION BY ticker)) THEN (close / entry - 1) * 100 END AS gain FROM e),
        st AS (SELECT ticker, arg_max(equity, date) AS eq, count(*) AS n, coalesce(avg(sr) FILTER (sr <> 0), 0) AS m, coalesce(stddev_samp(sr) FILTER (sr <> 0), 0) AS s, coalesce(sqrt(avg(sr * sr) FILTER (sr < 0)), 0) AS dn, least(min(dd), 0) AS mdd,
          coalesce(avg(CAST(gain > 0 AS DOUBLE)), 0) AS wr, coalesce(sum(gain) FILTER (gain > 0), 0) AS w, coalesce(-sum(gain) FILTER (gain <= 0), 0) AS l, count(gain) AS trades, sum(held) / count(*) AS ex FROM d GROUP BY ticker)
        SELECT ticker, trades, {sql(max_drawdown='mdd', win_rate='wr', exposure='ex', cagr='pow(eq, 1 / greatest(0.1, n / 252)) - 1', sharpe='CASE WHEN s > 0 THEN m * 252 / (s * sqrt(252)) ELSE 0 END', sortino='CASE WHEN dn > 0 THEN m * 252 / (dn * sqrt(252)) ELSE 0 END',
        profit_factor='CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 99 ELSE 0 END')} FROM st""",
    "strategy_sizings": f"""{_ENGINE} SELECT ticker, 'VOL_TARGET' AS sizing, round(product(1 + sr), 6) AS equity FROM q GROUP BY ticker UNION ALL SELECT ticker, 'FIXED', round(product(1 + held * r * 0.5), 6) FROM q GROUP BY ticker
        UNION ALL SELECT ticker, 'KELLY', round(product(1 + held * r * 0.3), 6) FROM q GROUP BY ticker""",
}
