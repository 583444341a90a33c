"""Wide tables, factor regressions, checks of weights, the efficient frontier, and the risk of a book of positions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_draw
from tidemark.functions.windows import YEAR, change, ratio
from tidemark.operators.optimize import frontier_weights

# Correlations of positions of one class and of different classes.
WITHIN, ACROSS = 0.35, 0.10
# Names and shocks of the book's scenarios: equity, oil and gold as shares, multiplier of option volatility.
SCENARIOS = (
    ("2008 CRISIS", -0.28, -0.35, 0.08, 2.5),
    ("COVID CRASH", -0.20, -0.45, 0.05, 3.0),
    ("RATES +100BP", -0.06, -0.02, -0.04, 1.3),
    ("OIL +20%", -0.02, 0.20, 0.02, 1.1),
    ("TECH -15%", -0.15, 0.00, 0.03, 1.4),
)
# Symbols that move with oil and with gold; the share of the equity shock that other commodities take.
OIL, GOLD, OTHER_SHARE = ("CL", "NG"), ("GC", "SI"), 0.4


def price_pivot(bars: DataFrame, tickers: list[str], value: str = "close", strict: bool = True) -> DataFrame:
    """One row per date, one column per ticker. The tickers are named, so no pass looks for them.

    strict: a repeated pair of date and ticker fails the job; else the row with the largest value stands for it.
    """
    once = F.when(F.count(value) > 1, F.raise_error(F.lit("repeated date and ticker")).cast("double")).otherwise(F.max(value))
    return bars.groupBy("date").pivot("ticker", tickers).agg(once if strict else F.max(value))


def returns_pivot(bars: DataFrame, tickers: list[str], value: str = "close") -> DataFrame:
    """Returns from each date to the next, one column per ticker; null where either price is missing."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    return price_pivot(bars, tickers, value, strict=False).select("date", *[change(t, w=w).alias(t) for t in tickers])


def between(bars: DataFrame, start: str, end: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars of a span of dates, ends included, and of some tickers; the filters come before any window."""
    out = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.filter(F.col("ticker").isin(tickers)) if tickers else out


def factor_exposures(wide: DataFrame, target: str, factors: list[str], least: int = 60) -> DataFrame:
    """(factor, beta, alpha_annual, r2, n) of a least-squares fit with intercept; no rows under `least` complete dates.

    All sums of squares and products come from one aggregation into a single row; the normal equations have one row per
    factor and are solved from that row.
    """
    names = [target, *factors]
    rows = wide.select(*[F.col(c).cast("double") for c in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])

    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["n"] < least:
                    continue
                k = len(names)
                cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
                alpha = row["m0"] - sum(b * row[f"m{i + 1}"] for i, b in enumerate(beta))
                explained = float(beta @ cov[1:, 0])
                r2 = explained / cov[0, 0] if cov[0, 0] > 0 else None
                yield pa.RecordBatch.from_pydict({"factor": factors, "beta": [float(b) for b in beta], "alpha_annual": [float(alpha) * YEAR] * (k - 1), "r2": [r2] * (k - 1), "n": [row["n"]] * (k - 1)})

    return sums.mapInArrow(solve, "factor string, beta double, alpha_annual double, r2 double, n long")


def weight_checks(weights: DataFrame, n_assets: int) -> DataFrame:
    """(check, status, value): ERROR where the count is wrong or a weight is missing, WARN where they do not sum to 1 or are negative."""
    s = weights.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w").isNull() | F.isnan("w")).alias("missing"), F.sum("w").alias("total"), F.count_if(F.col("w") < -1e-4).alias("short"))
    named = lambda check, status, value: F.struct(F.lit(check).alias("check"), status.alias("status"), value.alias("value"))
    rows = F.array(
        named("count", F.when(F.col("n") == n_assets, "PASS").otherwise("ERROR"), F.col("n").cast("double")),
        named("missing", F.when(F.col("missing") == 0, "PASS").otherwise("ERROR"), F.col("missing").cast("double")),
        named("sum", F.when(F.abs(F.col("total") - 1) <= 1e-4 + 1e-5, "PASS").otherwise("WARN"), F.col("total")),
        named("short", F.when(F.col("short") == 0, "PASS").otherwise("WARN"), F.col("short").cast("double")),
    )
    return s.select(F.inline(rows))


def performance(weights: DataFrame, means: DataFrame, cov: DataFrame, risk_free: float = 0.05) -> DataFrame:
    """One row: return, volatility and Sharpe of a book, its number of assets, largest and smallest holding (ties: first by name)."""
    wi, wj = (weights.select(F.col("ticker").alias(c), F.col("w").alias(f"w{c}")) for c in ("i", "j"))
    # weights and means have a row per asset; the covariances are reduced to one number
    variance = cov.join(wi, "i").join(wj, "j").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
    of_assets = weights.join(means, "ticker").agg(
        F.sum(F.col("w") * F.col("mu")).alias("expected_return"), F.count(F.lit(1)).alias("n_assets"),
        F.min(F.struct(-F.col("w"), "ticker"))["ticker"].alias("largest_asset"), F.max("w").alias("largest_weight"),
        F.min(F.struct("w", "ticker"))["ticker"].alias("smallest_asset"), F.min("w").alias("smallest_weight"),
    )
    both = of_assets.join(F.broadcast(variance))  # one row with one row
    both = both.withColumn("volatility", F.sqrt("variance")).drop("variance")
    return both.withColumn("sharpe", ratio(F.col("expected_return") - risk_free, F.nullif(F.col("volatility"), F.lit(0.0))))


def efficient_frontier(spark: SparkSession, names: list[str], mu: np.ndarray, sigma: np.ndarray, n: int = 50, most: float = 1.0, risk_free: float = 0.05) -> DataFrame:
    """(k, ticker, w, target_return, volatility, sharpe): weights from 0 to `most` of least variance for n evenly spaced returns.

    Targets are rows: each is solved in the task that holds it; those that no weights reach are left out.
    """
    targets = np.linspace(mu.min(), mu.max(), n)

    def solve(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                w = frontier_weights(mu, sigma, float(targets[k]), most)
                if w is None:
                    continue
                v = float(np.sqrt(max(0.0, w @ sigma @ w)))
                r = float(w @ mu)
                m = len(names)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * m, pa.int32()), "ticker": names, "w": w, "target_return": [float(targets[k])] * m, "volatility": [v] * m, "sharpe": pa.array([(r - risk_free) / v if v else None] * m, pa.float64())})

    spread = spark.range(n).select(F.col("id").cast("int").alias("k")).repartition(min(n, 64), "k")
    return spread.mapInArrow(solve, "k int, ticker string, w double, target_return double, volatility double, sharpe double")


def book_sigma(positions: DataFrame) -> DataFrame:
    """One row: the book's deviation over a day from each position's, with one correlation within classes and one across.

    The double sum over pairs is a sum over classes: no pairs are made. positions: cls, vol (a year), mv.
    """
    s = F.col("vol") / math.sqrt(YEAR) * F.abs("mv")
    per_class = positions.select("cls", s.alias("s")).groupBy("cls").agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    total = ACROSS * F.pow(F.sum("s"), 2) + (WITHIN - ACROSS) * F.sum(F.col("s") * F.col("s")) + (1 - WITHIN) * F.sum("ss")
    return per_class.agg(F.sqrt(F.greatest(F.lit(0.0), total)).alias("sigma"), F.sqrt(F.sum("ss")).alias("independent"))


def _tail(draws: DataFrame, method: str, n: int, level: float) -> DataFrame:
    """Value at risk and mean loss beyond it of n simulated results."""
    k = math.floor((1 - level) * n)
    ranked = draws.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pnl")) - 1)  # n rows
    return ranked.agg(F.lit(method).alias("method"), F.abs(F.max(F.when(F.col("rn") == k, F.col("pnl")))).alias("var"), F.abs(F.avg(F.when(F.col("rn") < max(1, k), F.col("pnl")))).alias("es"))


def book_value_at_risk(spark: SparkSession, positions: DataFrame, level: float = 0.95, z: float = 1.6448536269514722, seed: int = 42) -> DataFrame:
    """(method, var, es) of a day: normal, 500 Student draws of 5 degrees, and 2,000 normal draws of independent positions.

    The sum of independent normal results is normal, so a draw is made for the book and none for each position.
    """
    sigma = book_sigma(positions)
    tail = math.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * (1 - level))
    plain = sigma.select(F.lit("PARAMETRIC").alias("method"), (F.col("sigma") * z).alias("var"), (F.col("sigma") * tail).alias("es"))
    chi = sum((F.pow(normal_draw(F.col("id"), F.lit(g), seed=seed), 2) for g in range(1, 6)), F.lit(0.0))
    student = spark.range(500).select((normal_draw(F.col("id"), F.lit(0), seed=seed) / F.sqrt(chi / 5)).alias("z"))
    normal = spark.range(2000).select(normal_draw(F.col("id"), F.lit(0), seed=seed + 1).alias("z"))
    one = F.broadcast(sigma)  # one row
    historical = _tail(student.join(one).select((F.col("z") * F.col("sigma")).alias("pnl")), "HISTORICAL", 500, level)
    carlo = _tail(normal.join(one).select((F.col("z") * F.col("independent")).alias("pnl")), "MONTE_CARLO", 2000, level)
    return plain.unionByName(historical).unionByName(carlo)


def net_greeks(positions: DataFrame) -> DataFrame:
    """Sums of delta, gamma, vega and theta over the options of a book; missing ones count as 0."""
    return positions.filter(F.col("cls") == "OPTION").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("delta", "gamma", "vega", "theta")])


def scenario_losses(positions: DataFrame) -> DataFrame:
    """positions with scenario and pnl, one row for each scenario: equities by beta, commodities by kind, options by delta, gamma and vega."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(e).alias("equity"), F.lit(o).alias("oil"), F.lit(g).alias("gold"), F.lit(v).alias("vol_mult")) for n, e, o, g, v in SCENARIOS])
    each = positions.withColumn("_s", F.explode(rows))
    s, mv, beta = F.col("_s"), F.col("mv"), F.coalesce("beta", F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    commodity = F.when(F.col("symbol").isin(*OIL), s["oil"]).when(F.col("symbol").isin(*GOLD), s["gold"]).otherwise(s["equity"] * OTHER_SHARE) * mv
    move, under = s["equity"] * beta, F.abs(mv) / 100 * 20
    option = zero("delta") * move * under + 0.5 * zero("gamma") * move * move * under * under + zero("vega") * (s["vol_mult"] - 1) * 20
    pnl = F.when(F.col("cls") == "EQUITY", s["equity"] * beta * mv).when(F.col("cls") == "COMMODITY", commodity).when(F.col("cls") == "OPTION", option).otherwise(0.0)
    return each.select(*positions.columns, s["scenario"].alias("scenario"), pnl.alias("pnl"))


def checked_positions(rows: DataFrame, owner: Column | str = "owner") -> DataFrame:
    """(owner, valid, reason): whether the rows of an owner may replace the stored book: at most 100, no symbol twice, quantities finite and not 0."""
    q = F.col("quantity")
    out = rows.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.upper(F.trim("symbol"))).alias("symbols"),
        F.count_if(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")) | (q == 0)).alias("bad"),
    )
    reason = F.when(F.col("n") > 100, "too many positions").when(F.col("symbols") < F.col("n"), "repeated symbol").when(F.col("bad") > 0, "quantity not finite or zero").otherwise("ok")
    return out.select(owner, (reason == "ok").alias("valid"), reason.alias("reason"), "n")


def replaced_positions(stored: DataFrame, new: DataFrame, owner: str = "owner") -> DataFrame:
    """The books after owners with a valid new one had theirs replaced as a whole."""
    good = checked_positions(new, owner).filter("valid").select(owner)
    return stored.join(good, owner, "left_anti").unionByName(new.join(good, owner, "left_semi"))
