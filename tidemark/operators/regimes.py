"""What market regimes mean for a data set: risk, codes, transitions, a text, and reports of classes and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, ratio, run_starts

# Risk level, change of confidence and meaning of each regime, and of any other label.
RISKS = (
    ("Stress / Selloff", "High", -0.15, "Market is in a severe drawdown with high volatility. Protective stance recommended."),
    ("High-Vol Bearish", "High", -0.10, "Market is trending downward with elevated volatility. Bullish signals have lower reliability."),
    ("Low-Vol Bullish", "Low", 0.05, "Market is in a stable uptrend. Trend-following signals have higher reliability."),
    ("Sideways / Choppy", "Medium", -0.05, "Market lacks clear direction. Signal confidence is slightly reduced."),
    ("Recovery", "Medium", 0.00, "Market is bouncing from a drawdown. Elevated uncertainty remains."),
)
OTHER_RISK = ("Unknown", 0.00, "Regime state is unknown or undefined.")
# Codes of risk levels, and of those that have none.
RISK_CODES, OTHER_CODE = (("Low", 0), ("Moderate", 1), ("High", 2), ("Unknown", 1)), 1
# What a text says of each regime, and how it ends.
COMMENTS = (
    ("Stress / Selloff", "This indicates elevated volatility and severe drawdown risk. Directional long signals are generally suppressed or downgraded in this environment."),
    ("Sideways / Choppy", "This indicates weaker directional signal reliability. Mean-reversion strategies may perform better than trend-following."),
    ("Recovery", "This indicates improving returns after a selloff, but uncertainty typically remains elevated."),
    ("High-Vol Bearish", "This indicates a downward trend with high volatility. Caution is advised for long positions."),
    ("Low-Vol Bullish", "This indicates a stable, upward-trending environment where bullish signals have higher historical reliability."),
)
WARNING = " *However, regime labels are statistical approximations and should be used as context rather than standalone trading signals.*"
# Feature names of the regime models, by set; any other name than the two stands for the full one.
BASIC = ("log_return", "realized_vol_20", "rolling_return_20", "drawdown_from_252_high", "volume_zscore_20")
BENCHMARK = ("benchmark_return", "asset_minus_benchmark_return", "rolling_beta_60", "rolling_corr_60")
FULL = (
    "log_return", "abs_return", "squared_return", "rolling_return_5", "rolling_return_20", "rolling_return_60", "realized_vol_5", "realized_vol_20", "realized_vol_60",
    "volatility_ratio_5_20", "volatility_ratio_20_60", "drawdown_from_252_high", "max_drawdown_60", "price_to_sma_50", "price_to_sma_200", "trend_strength_50_200",
    "volume_zscore_20", "abnormal_volume_flag", *BENCHMARK,
)
# Starts of names that are no features.
NO_FEATURES = ("target_", "Date", "Ticker", "Open", "High", "Low", "Close", "Volume")


def _chosen(label: Column, pairs, other) -> Column:
    found = F.lit(None)
    for name, value in pairs:
        found = F.when(label == name, F.lit(value)) if name == pairs[0][0] else found.when(label == name, F.lit(value))
    return found.otherwise(F.lit(other))


def risk_level(label: Column) -> Column:
    return _chosen(label, [(r[0], r[1]) for r in RISKS], OTHER_RISK[0])


def confidence_change(label: Column) -> Column:
    return _chosen(label, [(r[0], r[2]) for r in RISKS], OTHER_RISK[1])


def meaning(label: Column) -> Column:
    return _chosen(label, [(r[0], r[3]) for r in RISKS], OTHER_RISK[2])


def with_regimes(rows: DataFrame, labels: DataFrame, label: str = "regime_label") -> DataFrame:
    """rows (ticker, date, ...) with their regime: label (Unknown without one), code by the order of labels, risk level and its
    code, length of the run so far, and whether it is the ticker's last label."""
    both = rows.join(labels.select("ticker", "date", label), ["ticker", "date"], "left").withColumn(label, F.coalesce(label, F.lit("Unknown")))
    every = Window.partitionBy("ticker")
    both = both.withColumn("_run", run_starts(label, by_date()))
    return both.withColumns({
        "regime_code": (F.dense_rank().over(every.orderBy(label)) - 1).cast("int"),
        "risk_level": risk_level(F.col(label)),
        "regime_duration": F.row_number().over(Window.partitionBy("ticker", "_run").orderBy("date")),
        "current_flag": (F.col(label) == F.max_by(label, "date").over(every)).cast("int"),
    }).withColumn("risk_code", _chosen(F.col("risk_level"), RISK_CODES, OTHER_CODE)).drop("_run")


def transition_analysis(shares: DataFrame, current: DataFrame) -> DataFrame:
    """Per ticker, of a matrix of transitions (ticker, before, after, share) and its last label (ticker, current): the labels that
    stay most and least often, the chance that the current one stays, the likeliest other one, and a sentence.

    Pairs that do not occur count as 0; the matrix has a row per pair of labels.
    """
    grid = shares.select("ticker", "before").distinct().join(shares.select("ticker", "after").distinct(), "ticker")
    full = grid.join(shares.select("ticker", "before", "after", "share"), ["ticker", "before", "after"], "left").fillna(0.0, ["share"])
    rows = full.join(current, "ticker", "right")
    stays, own = F.col("before") == F.col("after"), F.col("before") == F.col("current")
    most = F.min(F.when(stays, F.struct((-F.col("share")).alias("s"), F.col("before").alias("l"))))
    least = F.min(F.when(stays, F.struct(F.col("share").alias("s"), F.col("before").alias("l"))))
    next_ = F.min(F.when(own & ~stays, F.struct((-F.col("share")).alias("s"), F.col("after").alias("l"))))
    one = rows.groupBy("ticker", "current").agg(most.alias("m"), least.alias("k"), F.coalesce(F.max(F.when(stays & own, F.col("share"))), F.lit(0.0)).alias("stay"), next_.alias("x"))
    named = one.select(
        "ticker", "current", F.col("m.l").alias("most_stable"), (-F.col("m.s")).alias("most_stable_share"), F.col("k.l").alias("least_stable"), F.col("k.s").alias("least_stable_share"),
        F.col("stay").alias("stay_share"), F.coalesce("x.l", F.lit("Unknown")).alias("next_likely"), F.coalesce(-F.col("x.s"), F.lit(0.0)).alias("next_share"),
    )
    begin = F.format_string("The most stable market environment is %s (%.1f%% chance to remain). ", "most_stable", F.col("most_stable_share") * 100)
    rest = F.format_string("Currently in %s, there is a %.1f%% probability of staying in this state tomorrow, and a %.1f%% probability of transitioning to %s.", "current", F.col("stay_share") * 100, F.col("next_share") * 100, "next_likely")
    return named.withColumn("interpretation", F.when(F.col("most_stable").isNotNull(), F.concat(begin, F.when(F.col("current") != "Unknown", rest).otherwise(""))))


def interpretation(rows: DataFrame) -> DataFrame:
    """rows with text: name, label, probability and duration of the current regime, and what it did before (mean, volatility, hit_rate; null: not said)."""
    sure = F.when(F.col("probability") >= 0.8, "high assignment probability").when(F.col("probability") >= 0.5, "moderate assignment probability").otherwise("low assignment probability")
    begin = F.format_string("The %s is currently classified as **%s** with %s and a %d-day regime duration. ", "name", "label", sure, F.col("duration").cast("long"))
    sign = F.when(F.col("mean") > 0, "positive").otherwise("negative")
    size = F.when(F.col("volatility") > 0.25, "high").when(F.col("volatility") > 0.12, "moderate").otherwise("low")
    past = F.format_string("Historically, this regime has shown %s annualized returns (%.1f%%), %s volatility (%.1f%%), and a %.1f%% positive-day rate. ", sign, F.col("mean") * 100, size, F.col("volatility") * 100, F.col("hit_rate") * 100)
    return rows.withColumn("text", F.concat(begin, F.when(F.col("mean").isNotNull(), past).otherwise(""), _chosen(F.col("label"), COMMENTS, ""), F.lit(WARNING)))


def classification_report(rows: DataFrame, label: str = "y", predicted: str = "h") -> DataFrame:
    """(class, precision, recall, f1, support) of each class, and rows accuracy, macro avg and weighted avg; undefined ones are 0.

    Rows are counted by pair of classes first; all else is over these counts.
    """
    pairs = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    zero, n = F.lit(0).cast("long"), F.col("n")
    each = pairs.select(F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("h"), n).otherwise(zero).alias("hit"), n.alias("support"), zero.alias("said")),
        F.struct(F.col("h").alias("c"), zero.alias("hit"), zero.alias("support"), n.alias("said")),
    ))).groupBy("c").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "said")])
    share = lambda a, b: F.coalesce(ratio(a, F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    each = each.withColumns({"precision": share("hit", "said"), "recall": share("hit", "support")})
    both = F.col("precision") + F.col("recall")
    each = each.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.nullif(both, F.lit(0.0))), F.lit(0.0)))
    names = ("precision", "recall", "f1")
    total = F.sum("support").cast("double")
    macro = each.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("class"), *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("support"))
    right = ratio(F.sum("hit"), total)
    accuracy = each.agg(F.lit("accuracy").alias("class"), *[right.alias(c) for c in (*names, "support")])
    return each.select(F.col("c").cast("string").alias("class"), *names, F.col("support").cast("double").alias("support")).unionByName(accuracy).unionByName(macro).unionByName(weighted)


def prediction_summary(rows: DataFrame, predicted: str = "h", p: str | None = "p") -> DataFrame:
    """Mean prediction, share of ones (null if there are other values than 0 and 1), and mean probability."""
    h = F.col(predicted)
    out = [F.avg(h).alias("average_prediction"), F.when(F.bool_and(h.isin(0, 1)), F.avg((h == 1).cast("double"))).alias("positive_rate")]
    return rows.agg(*out, *([F.avg(p).alias("average_confidence")] if p else []))


def feature_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns that do not start as those of bars and targets do."""
    return [c for c, k in df.dtypes if not c.startswith(NO_FEATURES) and k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]


def regime_columns(df: DataFrame, which: str = "Basic") -> DataFrame:
    """(position, name) of the columns of a feature set that df has and that hold a value somewhere: counted in one pass."""
    wanted = BASIC if which == "Basic" else (*BASIC, *BENCHMARK) if which == "With Benchmark" else FULL
    there = [c for c in wanted if c in df.columns]
    counts = df.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(c) for c in there])
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), (F.col(c) > 0).alias("some")) for i, c in enumerate(there)])
    return counts.select(F.inline(each)).filter("some").drop("some")
