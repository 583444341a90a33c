"""Summary statistics, risk ratios, value at risk, correlation and data quality. One aggregation per ticker, partial sums first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, YEAR, change, drawdown, growth, ratio

# Normal quantiles and densities at 95 and 99 percent.
Z = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
DENSITY = {0.95: 0.10313564037537139, 0.99: 0.026652142203457715}
RISK_FREE = 0.05
DAYS_A_YEAR = 365.25


def clean(r: str = "r") -> Column:
    """Keeps finite values: neither null nor NaN nor infinite."""
    return F.col(r).isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf"))


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"r": change("close"), "dd": drawdown("close")})


def summary(bars: DataFrame, bench: DataFrame | None = None, risk_free: float = RISK_FREE) -> DataFrame:
    """Per ticker: price change, yearly growth by date and by rows, returns, volatility, ratios, drawdown, and beta with CAPM return."""
    rows = with_returns(bars)
    if bench is not None:
        rows = rows.join(bench, "date", "left").withColumn("b", change("bench_close"))
    r = F.col("r")
    loss = F.when(r < 0, r * r)
    days = F.date_diff(F.max("date"), F.min("date"))
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    out = rows.groupBy("ticker").agg(
        F.count("close").alias("n"), (ratio(last, first) - 1).alias("total_return"),
        F.when(days > 0, F.pow(ratio(last, first), DAYS_A_YEAR / days) - 1).alias("cagr"),
        (F.pow(ratio(last, first), YEAR / F.count("close").cast("double")) - 1).alias("annualized_return"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("mean"), F.coalesce(F.max(r), F.lit(0.0)).alias("best"), F.coalesce(F.min(r), F.lit(0.0)).alias("worst"),
        F.stddev_samp(r).alias("sd"), (F.sqrt(F.avg(loss)) * YEAR**0.5).alias("downside_deviation"), F.min("dd").alias("max_drawdown"),
        *([F.when(F.count(F.when(F.col("b").isNotNull(), r)) >= 2, ratio(F.covar_samp(r, F.col("b")), F.var_samp(F.when(r.isNotNull(), F.col("b"))))).alias("beta"), (F.avg("b") * YEAR).alias("market")] if bench is not None else []),
    )
    out = out.withColumns({
        "volatility": F.coalesce(F.col("sd"), F.lit(0.0)) * YEAR**0.5,
        "sharpe": ratio(F.col("mean") * YEAR - risk_free, F.nullif(F.col("sd"), F.lit(0.0)) * YEAR**0.5),
        "sortino": ratio(F.col("mean") * YEAR - risk_free, F.nullif(F.col("downside_deviation"), F.lit(0.0))),
    })
    return out.withColumn("capm", risk_free + F.col("beta") * (F.col("market") - risk_free)).drop("market", "sd") if bench is not None else out.drop("sd")


def risk_class(v: Column) -> Column:
    return F.when(v.isNull(), "Unknown").when(v < 0.15, "Low").when(v <= 0.30, "Medium").otherwise("High")


def risk_summary(bars: DataFrame) -> DataFrame:
    s = summary(bars)
    return s.select("ticker", "volatility", "downside_deviation", "max_drawdown", risk_class(F.col("volatility")).alias("risk_class"))


def by_sector(per_ticker: DataFrame, sectors: DataFrame) -> DataFrame:
    """Means over the tickers of a sector (tickers without one: Unknown), and the sector's rank by total return."""
    out = per_ticker.filter("n >= 2").join(sectors, "ticker", "left").groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(
        F.count(F.lit(1)).alias("tickers"), F.avg("total_return").alias("total_return"), F.avg("volatility").alias("volatility"), F.avg("max_drawdown").alias("max_drawdown"),
    )
    # one row per sector
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total_return"), "sector")))


def quality(bars: DataFrame) -> DataFrame:
    """Per ticker: rows, first and last date, missing cells, repeated dates, and the share of cells that hold a value in percent."""
    values = ("open", "high", "low", "close", "volume")
    missing = sum((F.sum(F.col(c).isNull().cast("int")) for c in values), F.lit(0))
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), missing.alias("missing"),
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("repeated_dates"),
        (100 - 100 * missing / (F.count(F.lit(1)) * len(values))).alias("completeness"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing): nulls of each column, from one pass."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing")


def correlations(bars: DataFrame) -> DataFrame:
    """(a, b, corr, n) for each pair of tickers a < b, over the dates on which both have a return; null under two of them."""
    rows = with_returns(bars).select("ticker", "date", "r").filter(F.col("r").isNotNull())
    left, right = rows.select(F.col("ticker").alias("a"), "date", F.col("r").alias("ra")), rows.select(F.col("ticker").alias("b"), "date", F.col("r").alias("rb"))
    both = left.join(right, "date").filter("a < b").groupBy("a", "b")
    return both.agg(F.when(F.count(F.lit(1)) >= 2, F.corr("ra", "rb")).alias("corr"), F.count(F.lit(1)).alias("n"))


def extreme_pairs(pairs: DataFrame) -> DataFrame:
    """The most and the least correlated pair; of ties the first by name."""
    key = lambda c: F.struct(c, "a", "b")
    out = pairs.filter(F.col("corr").isNotNull()).agg(F.min(key((-F.col("corr")).alias("k"))).alias("highest"), F.min(key(F.col("corr").alias("k"))).alias("lowest"))
    each = out.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"{k}.k") * by).alias("corr"), F.col(f"{k}.a").alias("a"), F.col(f"{k}.b").alias("b")) for k, by in (("highest", -1.0), ("lowest", 1.0))])).alias("p"))
    return each.select("p.*")


def value_at_risk(bars: DataFrame, level: float = 0.95) -> DataFrame:
    """Per ticker: historical, normal and Cornish-Fisher value at risk, the mean loss beyond it, and the normal one over ten rows."""
    rows = with_returns(bars).filter(F.col("r").isNotNull())
    z, r = Z[level], F.col("r")
    base = rows.groupBy("ticker").agg(F.percentile("r", 1 - level).alias("q"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"))
    # the moments above are over the population deviation, those wanted over the sample one
    shrink = F.sqrt((F.col("n") - 1) / F.col("n"))
    base = base.withColumns({"sk": F.col("sk") * F.pow(shrink, 3), "ku": (F.col("ku") + 3) * F.pow(shrink, 4) - 3})
    tail = rows.join(base.select("ticker", "q"), "ticker").filter(r <= F.col("q")).groupBy("ticker").agg(F.avg("r").alias("tail"))
    cf = z + (z * z - 1) * F.col("sk") / 6 + (z**3 - 3 * z) * F.col("ku") / 24 - (2 * z**3 - 5 * z) * F.pow(F.col("sk"), 2) / 36
    zero = F.lit(0.0)
    return base.join(tail, "ticker").select(
        "ticker", F.greatest(zero, -F.col("q")).alias("historical_var"), F.greatest(zero, -F.col("tail")).alias("historical_cvar"),
        F.greatest(zero, z * F.col("sd") - F.col("mu")).alias("parametric_var"), F.greatest(zero, F.col("sd") * DENSITY[level] / (1 - level) - F.col("mu")).alias("parametric_cvar"),
        (cf * F.col("sd") - F.col("mu")).alias("cornish_fisher_var"), (z * F.col("sd") * 10**0.5 - 10 * F.col("mu")).alias("var_10"),
    )


def drawdown_episodes(bars: DataFrame, top: int = 5) -> DataFrame:
    """Per ticker the deepest falls from a peak: peak, trough and recovery date (null if still open), depth and length in rows."""
    top_so_far = F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = bars.withColumns({"peak": top_so_far, "i": F.row_number().over(by_date())})
    rows = rows.withColumn("episode", F.sum((F.col("close") == F.col("peak")).cast("int")).over(by_date()))
    each = rows.groupBy("ticker", "episode").agg(
        F.min("date").alias("peak_date"), F.min_by("date", F.struct(F.col("close") / F.col("peak"), "date")).alias("trough_date"),
        F.min(F.col("close") / F.col("peak") - 1).alias("depth"), F.count(F.lit(1)).alias("length"),
    )
    each = each.withColumn("recovery_date", F.lead("peak_date").over(Window.partitionBy("ticker").orderBy("episode"))).filter("depth < 0")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("depth", "peak_date"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= top).select("ticker", "rank", "peak_date", "trough_date", "recovery_date", "depth", "length")


def runs(rows: DataFrame, label: str) -> DataFrame:
    """Runs of one label per ticker: first and last date and length."""
    from tidemark.functions.windows import run_starts

    return rows.withColumn("run", run_starts(label, by_date())).groupBy("ticker", "run").agg(F.first(label).alias(label), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("length"))


def transitions(rows: DataFrame, label: str) -> DataFrame:
    """How often each label follows another, as counts and as shares of the first one's."""
    pairs = rows.select("ticker", F.col(label).alias("before"), F.lead(label).over(by_date()).alias("after")).dropna().groupBy("ticker", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ticker", "before")))


def label_performance(rows: DataFrame, label: str) -> DataFrame:
    """Per label: rows, mean return of a year, volatility, their ratio, worst drawdown, and share of gains. Needs r and dd."""
    out = rows.groupBy("ticker", label).agg(F.count(F.lit(1)).alias("n"), (F.avg("r") * YEAR).alias("mean"), (F.stddev_samp("r") * YEAR**0.5).alias("volatility"), F.min("dd").alias("worst_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    return out.withColumn("sharpe", ratio("mean", F.nullif(F.col("volatility"), F.lit(0.0))))


def portfolio(bars: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    """One row of a weighted book over the dates on which every ticker has a return: yearly return, volatility, Sharpe, drawdown, VaR."""
    w = weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))
    n = weights.count()
    daily = with_returns(bars).filter(F.col("r").isNotNull()).join(F.broadcast(w), "ticker").groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == n)
    one = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    daily = daily.withColumn("value", growth("r", one)).withColumn("dd", drawdown("value", one))
    return daily.agg((F.avg("r") * YEAR).alias("mean"), (F.stddev_samp("r") * YEAR**0.5).alias("volatility"), F.min("dd").alias("max_drawdown"), F.greatest(F.lit(0.0), -F.percentile("r", 1 - level)).alias("var"), F.count(F.lit(1)).alias("n")).withColumn("sharpe", ratio(F.col("mean") - RISK_FREE, "volatility"))


def covariances(bars: DataFrame) -> DataFrame:
    """(i, j, cov) of yearly returns for each ordered pair, the own one included."""
    rows = with_returns(bars).filter(F.col("r").isNotNull()).select("ticker", "date", "r")
    left, right = rows.select(F.col("ticker").alias("i"), "date", F.col("r").alias("ri")), rows.select(F.col("ticker").alias("j"), "date", F.col("r").alias("rj"))
    return left.join(right, "date").groupBy("i", "j").agg((F.covar_samp("ri", "rj") * YEAR).alias("cov"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Per ticker: weight, marginal and whole contribution to the book's volatility, and its share."""
    wi, wj = weights.select(F.col("ticker").alias("i"), F.col("w").alias("wi")), weights.select(F.col("ticker").alias("j"), F.col("w").alias("wj"))
    per = cov.join(F.broadcast(wi), "i").join(F.broadcast(wj), "j").groupBy("i", "wi").agg(F.sum(F.col("wj") * F.col("cov")).alias("s"))
    every = Window.partitionBy(F.lit(0))  # one row per ticker
    per = per.withColumn("vol", F.sqrt(F.sum(F.col("wi") * F.col("s")).over(every)))
    return per.select(F.col("i").alias("ticker"), F.col("wi").alias("w"), ratio("s", "vol").alias("marginal"), ratio(F.col("wi") * F.col("s"), "vol").alias("contribution"), ratio(F.col("wi") * F.col("s"), F.col("vol") * F.col("vol")).alias("share"))


def lead_lag(pairs: DataFrame, most: int = 5) -> DataFrame:
    """Correlation of a with b shifted by -most..most rows, and which shift is strongest; pairs: i (row number), ra, rb."""
    shifted = pairs.select("i", "ra").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    other = pairs.select((F.col("i")).alias("k"), "rb")
    out = shifted.withColumn("k", F.col("i") + F.col("lag")).join(other, "k").groupBy("lag").agg(F.corr("ra", "rb").alias("corr"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("lag", F.struct(F.abs("corr"), -F.col("lag"))).over(Window.partitionBy(F.lit(0)))  # one row per lag
    return out.withColumn("strongest", F.col("lag") == best)
