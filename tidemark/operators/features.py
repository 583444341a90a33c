"""Return, volatility, volume and technical features of bars, and targets that look ahead.

Every function adds columns over one window per ticker, so that a chain of them sorts each ticker once. in_blocks runs any
of them over blocks of a ticker's rows instead; what needs all rows before (enriched, exponential) works in blocks by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, YEAR, change, gains, log_return, ratio, rolling, rolling2, rsi, zscore
from tidemark.operators.histories import DAYS, SIZE, exponential_means, framed, numbered, running

LAGS, MOMENTA, AVERAGES, VOLATILITIES = (1, 2, 3, 5, 10, 20), (5, 10, 20, 60, 120), (10, 20, 50, 100, 200), (5, 10, 20, 30, 60)


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"simple_return": change("close"), "log_return": log_return("close")})


def in_blocks(
    bars: DataFrame, f: Callable[[DataFrame], DataFrame], *, back: int, ahead: int = 0, size: int = SIZE, days: int = DAYS
) -> DataFrame:
    """f(bars), for features f that look at most `back` rows back and `ahead` rows ahead, over blocks of `size` rows."""
    rows = framed(numbered(bars, size=size, days=days), f, back=back, ahead=ahead, size=size)
    return rows.drop("_pos", "_block", "_key")


def enriched(bars: DataFrame, window: int = 20, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """Returns, cumulative return, rolling volatility of a year and drawdown, over blocks of `size` rows."""

    def frames(rows: DataFrame) -> DataFrame:
        return returns(rows).withColumn("rolling_volatility", rolling(F.stddev_samp, "simple_return", window) * YEAR**0.5)

    rows = framed(numbered(bars, size=size, days=days), frames, back=window, size=size)
    rows = running(rows, {"_growth": ("product", 1 + F.coalesce("simple_return", F.lit(0.0))), "_top": ("max", F.col("close"))})
    rows = rows.withColumns({"cumulative_return": F.col("_growth") - 1, "drawdown": ratio(F.col("close") - F.col("_top"), "_top")})
    return rows.drop("_growth", "_top", "_pos", "_block", "_key")


def bar_shape(bars: DataFrame) -> DataFrame:
    """Move within the bar, gap to the bar before, range, and where in its range the bar closed (0 without a range)."""
    span = F.col("high") - F.col("low")
    return bars.withColumns({
        "intraday_return": ratio("close", "open") - 1,
        "overnight_gap": ratio("open", F.lag("close").over(by_date())) - 1,
        "high_low_range": ratio("high", "low") - 1,
        "close_position": F.when(span == 0, 0.0).otherwise((F.col("close") - F.col("low")) / span),
    })


def lags(bars: DataFrame, column: str = "log_return", steps=LAGS) -> DataFrame:
    return bars.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(by_date()) for k in steps})


def momentum(bars: DataFrame, steps=MOMENTA) -> DataFrame:
    return bars.withColumns({f"momentum_{k}": change("close", k) for k in steps})


def averages(bars: DataFrame, windows=AVERAGES) -> DataFrame:
    """Moving averages and, for each, how far the price is from it and whether it is above (0 where there is none)."""
    out = bars.withColumns({f"sma_{n}": rolling(F.avg, "close", n) for n in windows})
    return out.withColumns({f"price_to_sma_{n}": ratio("close", f"sma_{n}") - 1 for n in windows} | {f"above_sma_{n}": F.coalesce(F.col("close") > F.col(f"sma_{n}"), F.lit(False)).cast("int") for n in windows})


def volatility(bars: DataFrame, windows=VOLATILITIES) -> DataFrame:
    """Rolling volatilities of a year, and those of losses alone (gains count as 0)."""
    out = bars.withColumns({f"vol_{n}": rolling(F.stddev_samp, "log_return", n) * YEAR**0.5 for n in windows})
    return out.withColumns({
        "vol_ratio_5_20": ratio("vol_5", "vol_20"), "vol_ratio_20_60": ratio("vol_20", "vol_60"),
        "downside_vol_20": rolling(F.stddev_samp, F.least("log_return", F.when(F.col("log_return").isNotNull(), 0.0)), 20) * YEAR**0.5,
    })


def volumes(bars: DataFrame) -> DataFrame:
    """Change, means and score of volume; a score of 0 where volume does not move."""
    flat = rolling(F.stddev_samp, "volume", 20) == 0
    out = bars.withColumns({
        "volume_change": change("volume"), "volume_ma_20": rolling(F.avg, "volume", 20), "volume_ma_60": rolling(F.avg, "volume", 60),
        "volume_z_20": F.when(flat, 0.0).otherwise(zscore("volume", 20)), "price_volume_trend": F.signum(change("close")) * F.col("volume"),
    })
    return out.withColumns({
        "abnormal_volume": F.coalesce(F.col("volume_z_20") > 2, F.lit(False)).cast("int"),
        "volume_regime": F.when(F.col("volume_z_20") > 1.5, "High Volume").otherwise("Normal"),
    })


def true_range() -> Column:
    before = F.lag("close").over(by_date())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def technicals(bars: DataFrame) -> DataFrame:
    """RSI of 14 and 30 rows, Bollinger bands of 20 rows and two deviations, true range of 14 rows."""
    up, down = gains("close")
    middle, spread = rolling(F.avg, "close", 20), rolling(F.stddev_samp, "close", 20)
    out = bars.withColumns({"_up": up, "_down": down, "_range": true_range()})
    out = out.withColumns({
        "rsi_14": rsi(rolling(F.avg, "_up", 14), rolling(F.avg, "_down", 14)), "rsi_30": rsi(rolling(F.avg, "_up", 30), rolling(F.avg, "_down", 30)),
        "bollinger_upper": middle + 2 * spread, "bollinger_lower": middle - 2 * spread, "bollinger_width": ratio(4 * spread, middle),
        "atr_14": rolling(F.avg, "_range", 14),
    })
    band = F.col("bollinger_upper") - F.col("bollinger_lower")
    return out.withColumn("percent_b", F.when(band == 0, 0.0).otherwise((F.col("close") - F.col("bollinger_lower")) / band)).drop("_up", "_down", "_range")


def exponential(bars: DataFrame, spans=(9, 12, 20, 26, 50), *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """Exponential means of the close, and MACD (12 less 26) with its signal of 9 and their difference.

    Each mean depends on the one before: blocks of `size` rows are affine maps of the means that they are entered with.
    A row without a close keeps the means before it.
    """
    names = [*(f"ema_{n}" for n in spans), "macd", "macd_signal", "macd_histogram"]
    means: dict = {f"ema_{n}": ("close", 2 / (n + 1)) for n in dict.fromkeys((*spans, 12, 26))}
    means["macd_signal"] = (("ema_12", "ema_26"), 2 / 10)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["macd"] = pdf["ema_12"] - pdf["ema_26"]
        pdf["macd_histogram"] = pdf["macd"] - pdf["macd_signal"]
        return pdf

    schema = "ticker string, date date, close double, " + ", ".join(f"{n} double" for n in names)
    rows = bars.select(F.col("ticker").cast("string"), "date", F.col("close").cast("double"))
    return exponential_means(numbered(rows, size=size, days=days), "close", means, finish, schema)


def year_range(bars: DataFrame, n: int = 252) -> DataFrame:
    """Distance from the highest and lowest close of the last n rows, or of as many as there are."""
    return bars.withColumns({"from_high": ratio("close", rolling(F.max, "close", n, least=1)) - 1, "from_low": ratio("close", rolling(F.min, "close", n, least=1)) - 1})


def relative(bars: DataFrame, bench: DataFrame, windows=(30, 60)) -> DataFrame:
    """Rolling beta and correlation with the benchmark's returns, and momentum over its own; no beta where it stands still."""
    out = bars.join(bench, "date", "left").withColumns({"r": change("close"), "b": change("bench_close")})
    cols = {"excess_return": F.col("r") - F.col("b")}
    for n in windows:
        cols[f"beta_{n}"] = F.try_divide(rolling2(F.covar_samp, F.col("r"), F.col("b"), n), rolling(F.var_samp, "b", n))
        cols[f"corr_{n}"] = rolling2(F.corr, F.col("r"), F.col("b"), n)
        cols[f"relative_momentum_{n}"] = change("close", n) - change("bench_close", n)
    return out.withColumns(cols)


def trend(bars: DataFrame) -> DataFrame:
    """Bullish above the 50-row mean that is above the 200-row mean, Bearish the other way round, Unknown without them."""
    short, long = rolling(F.avg, "close", 50), rolling(F.avg, "close", 200)
    return bars.withColumn("trend", F.when(short.isNull() | long.isNull(), "Unknown").when((F.col("close") > short) & (short > long), "Bullish").when((F.col("close") < short) & (short < long), "Bearish").otherwise("Neutral"))


def volatility_terciles(rows: DataFrame, column: str = "vol_20") -> DataFrame:
    """Low, Medium or High by thirds of a ticker's whole history (it looks ahead), Unknown without a value."""
    edges = rows.groupBy("ticker").agg(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("edges"))
    v = F.col(column)
    return rows.join(edges, "ticker").withColumn("volatility_regime", F.when(v.isNull(), "Unknown").when(v <= F.get("edges", F.lit(0)), "Low").when(v <= F.get("edges", F.lit(1)), "Medium").otherwise("High")).drop("edges")


def targets(bars: DataFrame, horizon: int = 1, vol_horizon: int = 5) -> DataFrame:
    """What follows a row: return and direction over `horizon` rows, strong moves, volatility of the next rows, and risk events."""
    ahead = ratio(F.lead("close", horizon).over(by_date()), "close") - 1
    frame = by_date().rowsBetween(1, vol_horizon)
    out = bars.withColumns({
        "future_return": ahead,
        "future_vol": F.when(F.count("log_return").over(frame) == vol_horizon, F.stddev_samp("log_return").over(frame)) * YEAR**0.5,
        "_vol": rolling(F.stddev_samp, "log_return", vol_horizon) * YEAR**0.5,
    })
    r = F.col("future_return")
    flag = lambda c: F.when(r.isNotNull(), F.coalesce(c, F.lit(False)).cast("int"))
    return out.withColumns({
        "direction": flag(r > 0), "strong_up": flag(r > 0.0075), "strong_down": flag(r < -0.0075),
        "risk_event": flag((r < -0.015) | F.coalesce(F.col("future_vol") > 1.5 * F.col("_vol"), F.lit(False))),
    }).drop("_vol")
