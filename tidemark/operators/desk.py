"""What a research desk asks for: suppressed signals, ratios, the news of a day, filings, snapshots, calibrated paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_draw
from tidemark.functions.windows import by_date, one_decimal, ratio, rolling, rolling2
from tidemark.operators.research import confidence, signal

# Ratios of reported figures.
RATIOS = (
    ("gross_margin", "gross_profit", "revenue"),
    ("operating_margin", "operating_income", "revenue"),
    ("net_margin", "net_income", "revenue"),
    ("roe", "net_income", "equity"),
    ("roa", "net_income", "assets"),
    ("current_ratio", "current_assets", "current_liabilities"),
    ("debt_to_equity", "liabilities", "equity"),
)
# How a signal is explained, with and without an edge.
SUPPRESSED = (
    "The model's out-of-sample validation edge is weak (ROC-AUC < 0.55 or Edge < 2%%). Although the raw probability "
    "suggests a %s move (%s%%), the signal is suppressed. This indicates the model cannot reliably separate noise "
    "from signal."
)
EXPLAINED = (
    "The model output places this asset in the %s zone. Validation quality is %s. Probability of an upward move is "
    "%s%%. Research confidence is rated as %s based on institutional confidence bands."
)
# Fixed value: worth of a book before the day's result.
NAV_BASE = 10_000_000.0


def institutional(rows: DataFrame) -> DataFrame:
    """rows (p, quality) with signal, strength, confidence, used (the probability of what is said), allowed and explanation: where the model is weak,
    nothing is signalled, whatever p. A missing p counts as 0.5."""
    p = F.coalesce("p", F.lit(0.5))
    rows = rows.withColumn("p", p)
    p, weak = F.col("p"), F.col("quality") == "Weak"
    base = F.when(p >= 0.57, "Bullish").when(p <= 0.43, "Bearish").otherwise("Neutral")
    rows = rows.withColumns({"signal": signal(p, F.col("quality")), "confidence": confidence(p), "allowed": ~weak, "used": F.when(p >= 0.57, p).when(p <= 0.43, 1 - p).otherwise(F.greatest(p, 1 - p))})
    no = F.format_string(SUPPRESSED, base, one_decimal(p * 100))
    yes = F.format_string(EXPLAINED, "signal", "quality", one_decimal(p * 100), "confidence")
    return rows.withColumns({"strength": F.when(weak, "Low").otherwise(F.col("confidence")), "explanation": F.when(weak, no).otherwise(yes)})


def fundamental_ratios(facts: DataFrame) -> DataFrame:
    """Per entity, of facts (entity, year, concept, value, filed, seq): the ratios of its latest figures, and the growth of revenue over the year
    before in the data. Null where a figure is missing or the lower one is 0."""
    annual = facts.groupBy("entity", "concept", "year").agg(F.max_by("value", F.struct("filed", "seq")).alias("value"))
    before = F.lag("value").over(Window.partitionBy("entity", "concept").orderBy("year"))
    rows = annual.withColumn("_before", before)
    names = sorted({c for _, a, b in RATIOS for c in (a, b)})
    last = rows.groupBy("entity").agg(
        *[F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.col("year"))).alias(c) for c in names],
        F.max_by(F.when(F.col("concept") == "revenue", F.struct("value", "_before")), F.when(F.col("concept") == "revenue", F.col("year"))).alias("_r"), F.max(F.when(F.col("concept") == "revenue", F.col("year"))).alias("latest_year"),
    )
    share = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0), ratio(a, b))
    return last.select("entity", "latest_year", *[share(a, b).alias(n) for n, a, b in RATIOS], (ratio("_r.value", F.nullif(F.col("_r._before"), F.lit(0.0))) - 1).alias("revenue_growth"))


def news_signal(rows: DataFrame, key: str) -> DataFrame:
    """Per key, of news_impact() rows (score, confidence, materiality, relevance): the mean score weighted by both, chances of either direction,
    label, and how sure the whole is."""
    sure = F.bround(F.round(F.col("confidence") * 100, 9))
    weight = F.greatest(F.lit(0.05), sure / 100) * F.greatest(F.lit(0.1), F.col("materiality") / 100)
    tagged = (F.col("relevance") == "PROVIDER-TAGGED").cast("int")
    s = rows.groupBy(key).agg(F.count(F.lit(1)).alias("headlines"), F.sum(tagged).alias("provider_tagged"), F.coalesce(F.sum(F.bround("score", 3) * weight) / F.sum(weight), F.lit(0.0)).alias("_s"))
    score, coverage = F.col("_s"), F.col("provider_tagged") / F.col("headlines")
    chance = lambda by: F.bround(F.round(F.greatest(F.lit(5.0), F.least(F.lit(95.0), 50 + by * score)), 9)).cast("int")
    return s.select(
        key, "headlines", "provider_tagged", F.bround(F.round("_s", 9), 3).alias("score"), F.when(score > 0.12, "BULLISH SKEW").when(score < -0.12, "BEARISH SKEW").otherwise("MIXED / WAIT").alias("label"),
        chance(42).alias("bullish"), chance(-42).alias("bearish"), F.bround(F.round(F.least(F.lit(96.0), 24 + coverage * 48 + F.least("headlines", F.lit(8)) * 3), 9)).cast("int").alias("confidence"),
    )


def drawdown_features(bars: DataFrame) -> DataFrame:
    """Distance from the high of 252 rows, deepest distance from the high of 60 rows within 60 rows (as many as there are), and the means of 50 and 200 rows against the price and each other."""
    rows = bars.withColumns({"_d60": ratio("close", F.max("close").over(by_date().rowsBetween(-59, 0))) - 1, "_m50": rolling(F.avg, "close", 50), "_m200": rolling(F.avg, "close", 200)})
    return rows.withColumns({
        "drawdown_from_252_high": ratio("close", F.max("close").over(by_date().rowsBetween(-251, 0))) - 1, "max_drawdown_60": F.min("_d60").over(by_date().rowsBetween(-59, 0)),
        "price_to_sma_50": ratio("close", "_m50") - 1, "price_to_sma_200": ratio("close", "_m200") - 1, "trend_strength_50_200": ratio("_m50", "_m200") - 1,
    }).drop("_d60", "_m50", "_m200")


def filings(rows: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q"), limit: int = 2) -> DataFrame:
    """The first `limit` filings of wanted forms of each row (ticker, cik, and parallel arrays form, accession, document, filed), in the order given; those
    without an accession number or a document are passed over."""
    each = rows.select("ticker", "cik", F.posexplode(F.arrays_zip("form", "accession", "document", "filed")).alias("position", "x")).select("ticker", "cik", "position", "x.*")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    wanted = each.filter(F.upper("form").isin(*[f.upper() for f in forms]) & some("accession") & some("document"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("position"))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col("cik").cast("string"), F.replace("accession", F.lit("-"), F.lit("")), "document")
    return wanted.withColumn("rank", rank).filter(F.col("rank") <= limit).select("ticker", "rank", "form", "filed", "accession", url.alias("url"))


def snapshot_by_id(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored rows of wanted ids (snapshot_id) that look like ids."""
    return stored.join(wanted.filter(F.col("snapshot_id").rlike("^[a-f0-9]{64}$")).distinct(), "snapshot_id", "left_semi")


def recorded_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the new rows whose id is not there yet: an answer that was stored before is stored once."""
    fresh = new.dropDuplicates(["snapshot_id"]).join(stored.select("snapshot_id"), "snapshot_id", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def rolling_correlation(pairs: DataFrame, window: int = 60, points: int = 40) -> DataFrame:
    """(date, corr) of ra and rb over the last `window` rows of pairs (date, ra, rb), thinned out to at most about `points` even steps. One row per date."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    rows = pairs.withColumn("corr", rolling2(F.corr, F.col("ra"), F.col("rb"), window, w)).filter("corr is not null")
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    step = F.when(F.col("_n") > points, F.floor(F.col("_n") / points) + 1).otherwise(1)
    return rows.filter(F.col("_i") % step == 0).select("date", "corr")


def calibrated_paths(params: DataFrame, years: float = 1.0, steps: int = 52, n: int = 500, seed: int = 42) -> DataFrame:
    """(ticker, sim, step, price) of geometric Brownian motion with each ticker's own start, mu and sigma; a missing or zero mu is 0.08, sigma 0.20."""
    dt = years / steps
    mu, sigma = F.coalesce(F.nullif(F.col("mu"), F.lit(0.0)), F.lit(0.08)), F.coalesce(F.nullif(F.col("sigma"), F.lit(0.0)), F.lit(0.20))
    rows = params.select("ticker", "start", mu.alias("mu"), sigma.alias("sigma"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sim")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    move = (F.col("mu") - F.col("sigma") * F.col("sigma") / 2) * dt + F.col("sigma") * dt**0.5 * normal_draw(F.col("ticker"), F.col("sim"), F.col("step"), seed=seed)
    rows = rows.withColumn("_z", F.when(F.col("step") > 0, move).otherwise(0.0))
    return rows.select("ticker", "sim", "step", (F.col("start") * F.exp(F.sum("_z").over(Window.partitionBy("ticker", "sim").orderBy("step")))).alias("price"))


def fan(rows: DataFrame, steps: list[int], shares=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles of the price of each ticker at some steps."""
    return rows.filter(F.col("step").isin(steps)).groupBy("ticker", "step").agg(*[F.percentile("price", s).alias(f"p{round(100 * s)}") for s in shares])


def book_value(positions: DataFrame, by: str) -> DataFrame:
    """Per group of positions (mv, pnl): worth, gross, net, long, short and the day's result."""
    long, short = F.sum(F.when(F.col("mv") >= 0, F.col("mv")).otherwise(0.0)), F.sum(F.when(F.col("mv") < 0, F.col("mv")).otherwise(0.0))
    return positions.groupBy(by).agg((NAV_BASE + F.sum("pnl")).alias("nav"), (long + F.abs(short)).alias("gross"), (long + short).alias("net"), long.alias("long"), short.alias("short"), F.sum("pnl").alias("pnl_day"))
