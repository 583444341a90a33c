"""Signals, fundamentals, books, scenarios, labels and evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, change, ratio
from tidemark.operators.features import in_blocks
from tidemark.operators.histories import DAYS, SIZE, exponential_means, numbered, rolling_quantile, weighted_deviation

# Market falls of past crises and a usual correction.
STRESS = (("Black Monday 1987", -0.205), ("GFC 2008 drawdown", -0.568), ("COVID crash 2020", -0.339), ("2022 rate shock", -0.254), ("Flash correction", -0.10))
# Phrases that tell a business segment.
SEGMENTS = {
    "O2C / Energy": ("o2c", "oil to chemicals", "refining", "petrochemicals", "energy"),
    "Digital Services / Telecom": ("jio", "digital services", "telecom", "broadband", "arpu"),
    "Retail": ("retail", "stores", "consumer", "reliance retail"),
    "IT Services": ("bfsi", "it services", "digital transformation", "cloud", "consulting"),
    "Banking / Financial": ("retail banking", "corporate banking", "treasury", "casa", "npa"),
}
GROWING, AT_RISK = ("growth", "increase", "strong", "momentum"), ("risk", "decline", "weak", "challenge")
# Endings that name a kind of company, taken off one after the other.
COMPANY_ENDINGS = (" ltd", " limited", " corporation", " corp", " inc", " plc", " co", " company", " platforms", " industries")


def signal_quality(auc: Column, edge: Column) -> Column:
    return F.when(auc.isNull() | edge.isNull(), "Unknown").when((auc >= 0.60) & (edge >= 0.05), "Strong").when((auc >= 0.55) & (edge >= 0.02), "Moderate").otherwise("Weak")


def signal(p: Column, quality: Column, bullish: float = 0.57, bearish: float = 0.43) -> Column:
    """Bullish, Bearish or Neutral by probability; none where the model is weak."""
    return F.when(quality == "Weak", "No Edge / Neutral").when(p >= bullish, "Bullish").when(p <= bearish, "Bearish").otherwise("Neutral")


def confidence(p: Column, bullish: float = 0.57, bearish: float = 0.43, margin: float = 0.08) -> Column:
    return F.when((p >= bullish + margin) | (p <= bearish - margin), "High").when((p >= bullish) | (p <= bearish), "Moderate").otherwise("Low")


def adjusted(sig: Column, regime: Column, conf: Column) -> Column:
    """Neutral instead of Bullish in stress, or in a volatile bearish regime on low confidence; instead of either in a choppy one on low confidence."""
    held = ((sig == "Bullish") & (regime == "Stress / Selloff")) | ((sig == "Bullish") & (regime == "High-Vol Bearish") & conf.isin("Low", "Medium")) | ((sig != "Neutral") & (regime == "Sideways / Choppy") & (conf == "Low"))
    return F.when(held, "Neutral").otherwise(sig)


def annual(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """(entity, year, value): the last filed value of a year, of the first concept that the entity has."""
    order = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    ranked = facts.filter(F.col("concept").isin(concepts)).withColumn("_o", order)
    ranked = ranked.withColumn("_first", F.min("_o").over(Window.partitionBy("entity"))).filter("_o = _first")
    return ranked.groupBy("entity", "year").agg(F.max_by("value", F.struct("filed", "seq")).alias("value"))


def fundamentals(facts: DataFrame) -> DataFrame:
    """Per entity and year: revenue (F, else O), cost (P), margin and growth over the year before in the data."""
    revenue, cost = annual(facts, ["F", "O"]).withColumnRenamed("value", "revenue"), annual(facts, ["P"]).withColumnRenamed("value", "cost")
    w = Window.partitionBy("entity").orderBy("year")
    return revenue.join(cost, ["entity", "year"], "left").withColumns({"margin": 1 - ratio("cost", "revenue"), "growth": change("revenue", w=w)})


def book(positions: DataFrame, by: str) -> DataFrame:
    """Per group of signed market values mv: net, gross, long, short, positions and largest share of gross."""
    mv = F.col("mv")
    out = positions.groupBy(by).agg(F.sum(mv).alias("net"), F.sum(F.abs(mv)).alias("gross"), F.sum(F.greatest(mv, F.lit(0.0))).alias("long"), F.sum(F.least(mv, F.lit(0.0))).alias("short"), F.count(F.lit(1)).alias("n"), F.max(F.abs(mv)).alias("_top"))
    return out.withColumn("concentration", ratio("_top", "gross")).drop("_top")


def stressed(groups: DataFrame, beta: Column) -> DataFrame:
    """(group columns, scenario, loss): net value times beta times each scenario's fall."""
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("shock")) for n, s in STRESS])
    rows = groups.withColumn("_b", beta).withColumn("_s", F.explode(scenarios))
    return rows.select(*[c for c in groups.columns if c != "net"], F.col("_s.scenario").alias("scenario"), (F.col("net") * F.col("_b") * F.col("_s.shock")).alias("loss"))


def plain_label(label: Column) -> Column:
    """Lower case, punctuation to blanks, blanks together, company endings off in their order."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9 ]+", " "), r"\s+", " "))
    for end in COMPANY_ENDINGS:
        out = F.trim(F.regexp_replace(out, f"{end}$", ""))
    return out


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "node").otherwise(made)


def health(rows: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Per key the status that comes first in `order`, and how many rows there are."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return rows.groupBy(key).agg(F.min_by(status, F.when(rank > 0, rank)).alias("status"), F.count(F.lit(1)).alias("n"))


def evidence(rows: DataFrame, key: str) -> DataFrame:
    """Per key: points shown (those with an active licence) and AVAILABLE, PARTIAL or UNAVAILABLE."""
    active = F.count_if(F.col("status") == "ACTIVE")
    return rows.groupBy(key).agg(active.alias("shown"), F.count(F.lit(1)).alias("n"), F.when(active == 0, "UNAVAILABLE").when(active < F.count(F.lit(1)), "PARTIAL").otherwise("AVAILABLE").alias("availability"))


def segments(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Per group and segment: texts that speak of it, and scores from 0.5 in steps for each that speaks of growth or of risk."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    any_of = lambda words: low.rlike("|".join(words))
    named = F.array(*[F.struct(F.lit(k).alias("segment"), any_of(v).alias("hit")) for k, v in SEGMENTS.items()])
    rows = df.select(by, any_of(GROWING).alias("g"), any_of(AT_RISK).alias("r"), F.explode(F.filter(named, lambda s: s["hit"])).alias("s"))
    g, r, one = F.count_if("g"), F.count_if("r"), F.lit(1.0)
    return rows.groupBy(by, F.col("s.segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.least(one, F.greatest(F.lit(0.0), 0.5 + 0.05 * g - 0.05 * r)).alias("sentiment"), F.least(one, 0.5 + 0.1 * g).alias("growth"), F.least(one, 0.5 + 0.1 * r).alias("risk"),
    )


def ewma(bars: DataFrame, decay: float = 0.94, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """Root of the mean of squared returns with fading weights, of a year: about zero, not about the moving mean (see
    ewm_deviation). The first row's square begins it. Blocks of `size` rows."""

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], "ewma_vol": (pdf["v"] * 252) ** 0.5})

    rows = numbered(_with_return(bars, size, days).withColumn("_sq", F.col("r") * F.col("r")), size=size, days=days)
    return exponential_means(rows, "_sq", {"v": ("_sq", 1 - decay)}, finish, "ticker string, date date, ewma_vol double")


def _with_return(bars: DataFrame, size: int, days: int) -> DataFrame:
    rows = in_blocks(bars.select("ticker", "date", "close"), lambda b: b.withColumn("r", change("close")), back=1, size=size, days=days)
    return rows.filter(F.col("r").isNotNull()).select("ticker", "date", "r")


def ewm_deviation(bars: DataFrame, alpha: float = 0.06, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """Deviation of returns about their exponential mean, freed from bias, of a year; missing for a single return."""
    rows = numbered(_with_return(bars, size, days), size=size, days=days)
    return weighted_deviation(rows, "r", alpha, "ewm_deviation", 252**0.5)


def rolling_value_at_risk(bars: DataFrame, window: int = 252, confidence: float = 0.95, *, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """The loss that returns of the last `window` rows exceed in 1 - confidence of all cases; missing until all are there."""
    rows = numbered(_with_return(bars, size, days), size=size, days=days)
    out = rolling_quantile(rows, "r", window, 1 - confidence, "var", size=size)
    return out.withColumn("var", -F.col("var"))


def quote(bars: DataFrame) -> DataFrame:
    """Per ticker: last close, place in the range of the last 52 rows (0 to 1), change in the last row's year, share of closes below."""
    w = by_date()
    last = Window.partitionBy("ticker")
    rows = bars.withColumns({"lo": F.min("low").over(w.rowsBetween(-51, 0)), "hi": F.max("high").over(w.rowsBetween(-51, 0)), "spot": F.max_by("close", "date").over(last), "year": F.max(F.year("date")).over(last)})
    return rows.groupBy("ticker").agg(
        F.max("spot").alias("close"), F.max_by(ratio(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")), "date").alias("range_position"),
        (ratio(F.max("spot"), F.min_by(F.when(F.year("date") == F.col("year"), F.col("close")), F.when(F.year("date") == F.col("year"), F.col("date")))) - 1).alias("year_to_date"), F.avg((F.col("close") < F.col("spot")).cast("double")).alias("percentile"),
    )


def bracketed(rows: DataFrame, take: float, stop: float) -> DataFrame:
    """(ticker, entry, exit, reason, trade_return): enter at a close where `enter` holds while flat; leave at the first later close that
    gained `take` or lost `stop`, or where `leave` holds. Depends on the path, so each ticker is walked once."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, at = pdf.sort_values("date"), [], None
        for date, close, enter, leave in zip(pdf["date"], pdf["close"], pdf["enter"], pdf["leave"]):
            if at is None:
                at = (date, close) if enter else None
                continue
            gain = close / at[1] - 1
            reason = "take" if gain >= take else "stop" if gain <= -stop else "rule" if leave else None
            if reason:
                out.append((pdf["ticker"].iloc[0], at[0], date, reason, gain))
                at = None
        return pd.DataFrame(out, columns=["ticker", "entry", "exit", "reason", "trade_return"])

    return rows.select("ticker", "date", "close", "enter", "leave").groupBy("ticker").applyInPandas(walk, "ticker string, entry date, exit date, reason string, trade_return double")
