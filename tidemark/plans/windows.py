"""Queries over ordered bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import rounded
from tidemark.operators import features as X
from tidemark.plans.sql import BENCH, BLOCKS, LAGGED, OVER, WEEKLY, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import benchmark, history, latest, segment_bars, standardized, tick_bars, weekly_bars

KEYS = ("ticker", "date")


def _out(df: DataFrame, *columns: str) -> DataFrame:
    """Keys, and the columns with doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *[rounded(c).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def _blocks(spark, d, f, back: int, ahead: int = 0) -> DataFrame:
    """f of the weekly bars, over blocks of a ticker's rows; f looks so far back and ahead."""
    return X.in_blocks(weekly_bars(spark, d), f, back=back, ahead=ahead, **BLOCKS)


def daily_bars(spark, d):
    return _out(weekly_bars(spark, d), "open", "high", "low", "close", "volume")


def order_bars(spark, d):
    return _out(segment_bars(spark, d), "open", "high", "low", "close", "volume")


def event_bars(spark, d):
    return tick_bars(spark, d).select("ticker", "ts", *[rounded(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


def scan_history(spark, d):
    return _out(history(standardized(weekly_bars(spark, d)), ["A", "R"], "1996-01-01", "1997-12-31"), "close", "volume")


def scan_latest(spark, d):
    return _out(latest(weekly_bars(spark, d), "N", 100), "close")


def returns(spark, d):
    return _out(_blocks(spark, d, X.returns, 1), "simple_return", "log_return")


def enriched(spark, d):
    return _out(X.enriched(weekly_bars(spark, d), **BLOCKS), "simple_return", "log_return", "cumulative_return", "rolling_volatility", "drawdown")


def bar_shape(spark, d):
    return _out(_blocks(spark, d, X.bar_shape, 1), "intraday_return", "overnight_gap", "high_low_range", "close_position")


def lag_features(spark, d):
    return _out(_blocks(spark, d, lambda bars: X.lags(X.returns(bars)), max(X.LAGS) + 1), *(f"log_return_lag_{k}" for k in X.LAGS))


def momentum_features(spark, d):
    return _out(_blocks(spark, d, X.momentum, max(X.MOMENTA)), *(f"momentum_{k}" for k in X.MOMENTA))


def average_features(spark, d):
    return _out(_blocks(spark, d, X.averages, max(X.AVERAGES)), *(f"{p}_{n}" for n in X.AVERAGES for p in ("sma", "price_to_sma", "above_sma")))


def volatility_features(spark, d):
    rows = _blocks(spark, d, lambda bars: X.volatility(X.returns(bars)), max(X.VOLATILITIES) + 1)
    return _out(rows, *(f"vol_{n}" for n in X.VOLATILITIES), "vol_ratio_5_20", "vol_ratio_20_60", "downside_vol_20")


def volume_features(spark, d):
    names = ("volume_change", "volume_ma_20", "volume_ma_60", "volume_z_20", "price_volume_trend", "abnormal_volume", "volume_regime")
    return _out(_blocks(spark, d, X.volumes, 60), *names)


def technical_features(spark, d):
    names = ("rsi_14", "rsi_30", "bollinger_upper", "bollinger_lower", "bollinger_width", "percent_b", "atr_14")
    return _out(_blocks(spark, d, X.technicals, 31), *names)


def exponential_features(spark, d):
    rows = X.exponential(weekly_bars(spark, d), **BLOCKS)
    return _out(rows, "ema_9", "ema_12", "ema_20", "ema_26", "ema_50", "macd", "macd_signal", "macd_histogram")


def year_range(spark, d):
    return _out(_blocks(spark, d, X.year_range, 251), "from_high", "from_low")


def relative_features(spark, d):
    bars = weekly_bars(spark, d)
    return _out(X.relative(bars, benchmark(bars)), "excess_return", *(f"{p}_{n}" for n in (30, 60) for p in ("beta", "corr", "relative_momentum")))


def trend_regime(spark, d):
    return _out(_blocks(spark, d, X.trend, 199), "trend")


def volatility_regime(spark, d):
    return _out(X.volatility_terciles(X.volatility(X.returns(weekly_bars(spark, d)))), "volatility_regime")


def targets(spark, d):
    rows = _blocks(spark, d, lambda bars: X.targets(X.returns(bars)), back=6, ahead=5)
    return _out(rows, "future_return", "future_vol", "direction", "strong_up", "strong_down", "risk_event")


def perf(spark, d):
    """Last close, changes over 1, 21 and 63 rows, and trend against the 50-row mean, per ticker."""
    from tidemark.functions.windows import change, rolling as roll

    rows = weekly_bars(spark, d).withColumns({"chg_1": change("close"), "chg_21": change("close", 21), "chg_63": change("close", 63), "sma": roll(F.avg, "close", 50)})
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("close", "chg_1", "chg_21", "chg_63", "sma"), "date").alias("l"))
    trend = F.when(F.col("l.sma").isNull(), "Unknown").when(F.col("l.close") > F.col("l.sma"), "Up").otherwise("Down")
    return last.select("ticker", *[rounded(f"l.{c}").alias(c) for c in ("close", "chg_1", "chg_21", "chg_63")], trend.alias("trend"))


def pivots(spark, d):
    """Nearest three levels above and below the last close, of closes that are the extremes of the ten bars either side."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    near, every = w.rowsBetween(-10, 10), Window.partitionBy("ticker")
    rows = weekly_bars(spark, d).withColumns({
        "hi": F.max("high").over(near), "lo": F.min("low").over(near), "rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(every), "spot": F.max_by("close", "date").over(every),
    }).filter((F.col("rn") > 10) & (F.col("rn") <= F.col("n") - 10))
    levels = rows.select("ticker", "spot", F.explode(F.array(F.when(F.col("high") == F.col("hi"), F.round("high", 2)), F.when(F.col("low") == F.col("lo"), F.round("low", 2)))).alias("level")).dropna().distinct()
    side = F.when(F.col("level") > F.col("spot"), "resistance").otherwise("support")
    rank = F.row_number().over(Window.partitionBy("ticker", "side").orderBy(F.abs(F.col("level") - F.col("spot")), "level"))
    return levels.withColumn("side", side).withColumn("rank", rank).filter("rank <= 3").select("ticker", "side", "rank", "level")


_BARS = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"
_EMA = """WITH RECURSIVE {w}, o AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars),
e AS (
  SELECT ticker, date, i, close AS e9, close AS e12, close AS e20, close AS e26, close AS e50, CAST(0 AS DOUBLE) AS s FROM o WHERE i = 1
  UNION ALL
  SELECT n.ticker, n.date, n.i, n.e9, n.e12, n.e20, n.e26, n.e50, n.s + 0.2 * (n.e12 - n.e26 - n.s)
  FROM (SELECT o.ticker, o.date, o.i, e9 + 2.0 / 10 * (close - e9) AS e9, e12 + 2.0 / 13 * (close - e12) AS e12, e20 + 2.0 / 21 * (close - e20) AS e20,
               e26 + 2.0 / 27 * (close - e26) AS e26, e50 + 2.0 / 51 * (close - e50) AS e50, s
        FROM o JOIN e ON o.ticker = e.ticker AND o.i = e.i + 1) n
)
SELECT ticker, date, round(e9, 6) AS ema_9, round(e12, 6) AS ema_12, round(e20, 6) AS ema_20, round(e26, 6) AS ema_26, round(e50, 6) AS ema_50,
       round(e12 - e26, 6) AS macd, round(s, 6) AS macd_signal, round(e12 - e26 - s, 6) AS macd_histogram FROM e"""
_YEAR = "sqrt(252)"


def _change(c: str, n: int) -> str:
    return f"({c} / lag({c}, {n}) {OVER} - 1)"


def _pair(f: str, n: int) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count(x.r + x.b) {over} = {n} THEN {f} {over} END)"


_RELATIVE = ", ".join(
    f"round({_pair('covar_samp(r, b)', n)} / {_pair('var_samp(b)', n)}, 6) AS beta_{n}, round({_pair('corr(r, b)', n)}, 6) AS corr_{n}, "
    f"round({_change('close', n)} - {_change('bench_close', n)}, 6) AS relative_momentum_{n}" for n in (30, 60)
)
_UP, _DOWN = f"greatest(close - lag(close) {OVER}, 0.0)", f"greatest(lag(close) {OVER} - close, 0.0)"
_RSI = lambda n: f"100 - 100 / (1 + {rolling('avg', 'up', n)} / nullif({rolling('avg', 'down', n)}, 0))"

QUERIES = {
    "daily_bars": daily_bars, "order_bars": order_bars, "event_bars": event_bars, "scan_history": scan_history, "scan_latest": scan_latest,
    "window_returns": returns, "window_enriched": enriched, "window_bar_shape": bar_shape, "window_lags": lag_features, "window_momentum": momentum_features,
    "window_averages": average_features, "window_volatility": volatility_features, "window_volume": volume_features, "window_technicals": technical_features,
    "window_exponential": exponential_features, "window_year_range": year_range, "window_relative": relative_features, "window_trend": trend_regime,
    "window_volatility_regime": volatility_regime, "window_targets": targets, "window_perf": perf, "window_pivots": pivots,
}

ORACLE_SQL = {
    "daily_bars": f"WITH {WEEKLY} SELECT ticker, date, {_BARS}, round(volume, 6) AS volume FROM bars",
    "order_bars": f"""WITH b AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
        max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT ticker, date, {_BARS}, round(volume, 6) AS volume FROM b""",
    "event_bars": f"""WITH b AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT ticker, ts, {_BARS}, volume FROM b""",
    "scan_history": f"WITH {WEEKLY} SELECT ticker, date, round(close, 6) AS close, round(volume, 6) AS volume FROM bars WHERE ticker IN ('A', 'R') AND date BETWEEN '1996-01-01' AND '1997-12-31'",
    "scan_latest": f"WITH {WEEKLY} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE ticker = 'N' ORDER BY date DESC LIMIT 100",
    "window_returns": f"WITH {LAGGED} SELECT ticker, date, {sql(simple_return='simple_return', log_return='log_return')} FROM r",
    "window_enriched": f"""WITH {LAGGED}, c AS (SELECT *, product(1 + coalesce(simple_return, 0)) {OVER} - 1 AS cumulative_return,
        {rolling('stddev_samp', 'simple_return', 20)} * {_YEAR} AS rolling_volatility, close / max(close) {OVER} - 1 AS drawdown FROM r)
        SELECT ticker, date, {sql(**{c: c for c in ('simple_return', 'log_return', 'cumulative_return', 'rolling_volatility', 'drawdown')})} FROM c""",
    "window_bar_shape": f"""WITH {WEEKLY} SELECT ticker, date, round(close / open - 1, 6) AS intraday_return, round(open / lag(close) {OVER} - 1, 6) AS overnight_gap,
        round(high / low - 1, 6) AS high_low_range, round(CASE WHEN high = low THEN 0 ELSE (close - low) / (high - low) END, 6) AS close_position FROM bars""",
    "window_lags": f"WITH {LAGGED} SELECT ticker, date, {sql(**{f'log_return_lag_{k}': f'lag(log_return, {k}) {OVER}' for k in X.LAGS})} FROM r",
    "window_momentum": f"WITH {WEEKLY} SELECT ticker, date, {sql(**{f'momentum_{k}': _change('close', k) for k in X.MOMENTA})} FROM bars",
    "window_averages": f"WITH {WEEKLY} SELECT ticker, date, " + ", ".join(f"round({rolling('avg', 'close', n)}, 6) AS sma_{n}, round(close / {rolling('avg', 'close', n)} - 1, 6) AS price_to_sma_{n}, CAST(coalesce(close > {rolling('avg', 'close', n)}, false) AS INTEGER) AS above_sma_{n}" for n in X.AVERAGES) + " FROM bars",
    "window_volatility": f"WITH {LAGGED}, d AS (SELECT *, least(log_return, CASE WHEN log_return IS NOT NULL THEN 0.0 END) AS loss FROM r), v AS (SELECT ticker, date, " + ", ".join(f"{rolling('stddev_samp', 'log_return', n)} * {_YEAR} AS vol_{n}" for n in X.VOLATILITIES) + f", {rolling('stddev_samp', 'loss', 20)} * {_YEAR} AS downside FROM d) SELECT ticker, date, " + sql(**{f"vol_{n}": f"vol_{n}" for n in X.VOLATILITIES}, vol_ratio_5_20="vol_5 / nullif(vol_20, 0)", vol_ratio_20_60="vol_20 / nullif(vol_60, 0)", downside_vol_20="downside") + " FROM v",
    "window_volume": f"""WITH {WEEKLY}, v AS (SELECT *, {rolling('avg', 'volume', 20)} AS m, {rolling('avg', 'volume', 60)} AS m60, {rolling('stddev_samp', 'volume', 20)} AS s,
        {_change('volume', 1)} AS ch, sign({_change('close', 1)}) * volume AS pvt FROM bars), z AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE (volume - m) / s END AS z FROM v)
        SELECT ticker, date, {sql(volume_change='ch', volume_ma_20='m', volume_ma_60='m60', volume_z_20='z', price_volume_trend='pvt')},
        CAST(coalesce(z > 2, false) AS INTEGER) AS abnormal_volume, CASE WHEN z > 1.5 THEN 'High Volume' ELSE 'Normal' END AS volume_regime FROM z""",
    "window_technicals": f"""WITH {WEEKLY}, g AS (SELECT *, CASE WHEN lag(close) {OVER} IS NOT NULL THEN {_UP} END AS up, CASE WHEN lag(close) {OVER} IS NOT NULL THEN {_DOWN} END AS down,
        greatest(high - low, abs(high - lag(close) {OVER}), abs(low - lag(close) {OVER})) AS tr FROM bars),
        t AS (SELECT ticker, date, close, {_RSI(14)} AS rsi_14, {_RSI(30)} AS rsi_30, {rolling('avg', 'close', 20)} AS m, {rolling('stddev_samp', 'close', 20)} AS s, {rolling('avg', 'tr', 14)} AS atr FROM g)
        SELECT ticker, date, {sql(rsi_14='rsi_14', rsi_30='rsi_30', bollinger_upper='m + 2 * s', bollinger_lower='m - 2 * s', bollinger_width='4 * s / m',
        percent_b='CASE WHEN s = 0 THEN 0 ELSE (close - (m - 2 * s)) / (4 * s) END', atr_14='atr')} FROM t""",
    "window_exponential": _EMA.format(w=WEEKLY),
    "window_year_range": f"WITH {WEEKLY} SELECT ticker, date, {sql(from_high=f'close / {rolling('max', 'close', 252, 1)} - 1', from_low=f'close / {rolling('min', 'close', 252, 1)} - 1')} FROM bars",
    "window_relative": f"WITH {WEEKLY}, {BENCH}, x AS (SELECT bars.*, bench_close, {_change('close', 1)} AS r, {_change('bench_close', 1)} AS b FROM bars LEFT JOIN bench USING (date)) SELECT ticker, date, round(r - b, 6) AS excess_return, {_RELATIVE} FROM x",
    "window_trend": f"""WITH {WEEKLY}, s AS (SELECT *, {rolling('avg', 'close', 50)} AS a, {rolling('avg', 'close', 200)} AS b FROM bars) SELECT ticker, date,
        CASE WHEN a IS NULL OR b IS NULL THEN 'Unknown' WHEN close > a AND a > b THEN 'Bullish' WHEN close < a AND a < b THEN 'Bearish' ELSE 'Neutral' END AS trend FROM s""",
    "window_volatility_regime": f"""WITH {LAGGED}, v AS (SELECT ticker, date, {rolling('stddev_samp', 'log_return', 20)} AS v FROM r),
        e AS (SELECT ticker, quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM v GROUP BY ticker)
        SELECT ticker, date, CASE WHEN v IS NULL THEN 'Unknown' WHEN v <= a THEN 'Low' WHEN v <= b THEN 'Medium' ELSE 'High' END AS volatility_regime FROM v JOIN e USING (ticker)""",
    "window_targets": f"""WITH {LAGGED}, t AS (SELECT *, lead(close) {OVER} / close - 1 AS f, {rolling('stddev_samp', 'log_return', 5)} * {_YEAR} AS v,
        CASE WHEN count(log_return) OVER n = 5 THEN stddev_samp(log_return) OVER n END * {_YEAR} AS fv FROM r
        WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
        SELECT ticker, date, round(f, 6) AS future_return, round(fv, 6) AS future_vol, CAST(f > 0 AS INTEGER) AS direction, CAST(f > 0.0075 AS INTEGER) AS strong_up,
        CAST(f < -0.0075 AS INTEGER) AS strong_down, CASE WHEN f IS NOT NULL THEN CAST(f < -0.015 OR coalesce(fv > 1.5 * v, false) AS INTEGER) END AS risk_event FROM t""",
    "window_perf": f"""WITH {WEEKLY}, p AS (SELECT ticker, date, close, {_change('close', 1)} AS a, {_change('close', 21)} AS b, {_change('close', 63)} AS c, {rolling('avg', 'close', 50)} AS s,
        row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) SELECT ticker, {sql(close='close', chg_1='a', chg_21='b', chg_63='c')},
        CASE WHEN s IS NULL THEN 'Unknown' WHEN close > s THEN 'Up' ELSE 'Down' END AS trend FROM p WHERE n = 1""",
    "window_pivots": f"""WITH {WEEKLY}, p AS (SELECT *, max(high) OVER n AS hi, min(low) OVER n AS lo, row_number() {OVER} AS rn, count(*) OVER (PARTITION BY ticker) AS k,
        last_value(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS spot FROM bars
        WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
        l AS (SELECT ticker, spot, round(high, 2) AS level FROM p WHERE high = hi AND rn > 10 AND rn <= k - 10 UNION SELECT ticker, spot, round(low, 2) FROM p WHERE low = lo AND rn > 10 AND rn <= k - 10),
        s AS (SELECT *, CASE WHEN level > spot THEN 'resistance' ELSE 'support' END AS side FROM l),
        q AS (SELECT ticker, side, CAST(row_number() OVER (PARTITION BY ticker, side ORDER BY abs(level - spot), level) AS INTEGER) AS rank, level FROM s) SELECT * FROM q WHERE rank <= 3""",
}
