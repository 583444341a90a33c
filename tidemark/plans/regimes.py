"""Queries of regimes in data sets, their transitions and texts, and of class reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, change, ratio, rolling as roll, run_starts
from tidemark.operators import features as X
from tidemark.operators import regimes as R
from tidemark.operators import stats as S
from tidemark.plans.models import _labelled
from tidemark.plans.sql import OVER, WEEKLY, out
from tidemark.plans.sql import rounded as sql
from tidemark.plans.stats import _TREND
from tidemark.sources.bars import weekly_bars


def _named(trend, dd):
    return F.when(trend == "Bullish", "Low-Vol Bullish").when((trend == "Bearish") & (dd < -0.25), "Stress / Selloff").when(trend == "Bearish", "High-Vol Bearish").when(dd > -0.1, "Recovery").otherwise("Sideways / Choppy")


def _labels(spark, d):
    rows = X.trend(S.with_returns(weekly_bars(spark, d))).filter("trend <> 'Unknown'")
    return rows.select("ticker", "date", "r", "dd", _named(F.col("trend"), F.col("dd")).alias("regime_label"))


def context(spark, d):
    rows = weekly_bars(spark, d).select("ticker", "date", change("close").alias("r"))
    return out(R.with_regimes(rows, _labels(spark, d)))


def risks(spark, d):
    rows = _labels(spark, d).select("regime_label").unionByName(weekly_bars(spark, d).select(F.lit("Other").alias("regime_label")))
    label = F.col("regime_label")
    return rows.groupBy(label, R.risk_level(label).alias("risk_level"), R.confidence_change(label).alias("adjustment"), R.meaning(label).alias("meaning")).agg(F.count(F.lit(1)).alias("n"))


def transition_analysis(spark, d):
    rows = _labels(spark, d)
    shares = S.transitions(rows.select("ticker", "date", "regime_label"), "regime_label")
    current = rows.groupBy("ticker").agg(F.max_by("regime_label", "date").alias("current"))
    return out(R.transition_analysis(shares, current))


def interpretation(spark, d):
    """The last regime of each ticker: its share of the last 20 rows as probability, the length of its run, and its past."""
    rows = _labels(spark, d).withColumn("run", run_starts("regime_label", by_date()))
    rows = rows.withColumns({"back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))), "last": F.max_by(F.struct("regime_label", "run"), "date").over(Window.partitionBy("ticker"))})
    now = rows.groupBy("ticker").agg(
        F.max("last.regime_label").alias("label"), F.count_if(F.col("run") == F.col("last.run")).alias("duration"),
        F.avg(F.when(F.col("back") <= 20, (F.col("regime_label") == F.col("last.regime_label")).cast("double"))).alias("probability"),
    )
    past = S.label_performance(rows, "regime_label").select("ticker", F.col("regime_label").alias("label"), "mean", "volatility", "hit_rate")
    return R.interpretation(now.join(past, ["ticker", "label"], "left").withColumn("name", F.concat(F.lit("ticker "), "ticker"))).select("ticker", "label", "text")


def report(spark, d):
    return out(R.classification_report(_labelled(spark, d).withColumn("h", (F.col("p") >= 0.5).cast("int"))))


def prediction_summary(spark, d):
    return out(R.prediction_summary(_labelled(spark, d).withColumn("h", (F.col("p") >= 0.5).cast("int"))))


def feature_columns(spark, d):
    """Names of the features of a data set, in order, by their types and names, and how many rows have each."""
    rows = X.targets(X.volatility(X.momentum(X.returns(weekly_bars(spark, d)), (5, 20)), (5, 20, 60)))
    renamed = rows.withColumnsRenamed({c: c.capitalize() for c in ("ticker", "date", "open", "high", "low", "close", "volume")})
    renamed = renamed.withColumnsRenamed({c: f"target_{c}" for c in ("future_return", "future_vol", "direction", "strong_up", "strong_down", "risk_event")})
    names = sorted(R.feature_columns(renamed))
    counts = renamed.agg(*[F.count(c).alias(c) for c in names])
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(names)])
    return counts.select(F.inline(each))


def regime_columns(spark, d):
    """The features of the basic set that hold values: the z-score of a constant volume never does."""
    bars = weekly_bars(spark, d).withColumn("even", F.lit(1.0))
    rows = bars.select("ticker", "date", X.log_return("close").alias("log_return"), change("close", 20).alias("rolling_return_20"), (ratio("close", roll(F.max, "close", 252, least=1)) - 1).alias("drawdown_from_252_high"),
                       ratio(F.col("even") - roll(F.avg, "even", 20), roll(F.stddev_samp, "even", 20)).alias("volume_zscore_20"))
    return R.regime_columns(rows)


def _case(name: str, pairs, other: str) -> str:
    q = lambda s: str(s) if isinstance(s, (int, float)) else "'" + s.replace("'", "''") + "'"
    return f"(CASE {' '.join(f'WHEN {name} = {q(a)} THEN {q(b)}' for a, b in pairs)} ELSE {q(other)} END)"


_LABELS = f"""{_TREND}, g AS (SELECT ticker, date, r, dd, CASE WHEN trend = 'Bullish' THEN 'Low-Vol Bullish' WHEN trend = 'Bearish' AND dd < -0.25 THEN 'Stress / Selloff' WHEN trend = 'Bearish' THEN 'High-Vol Bearish'
  WHEN dd > -0.1 THEN 'Recovery' ELSE 'Sideways / Choppy' END AS label FROM l WHERE trend <> 'Unknown')"""
_LEVEL = lambda c: _case(c, [(x[0], x[1]) for x in R.RISKS], R.OTHER_RISK[0])
_RUNS = f"{_LABELS}, n AS (SELECT *, CASE WHEN label = lag(label) {OVER} THEN 0 ELSE 1 END AS new FROM g), u AS (SELECT *, sum(new) {OVER} AS run2 FROM n)"
_Y = "d AS (SELECT quality AS y, n_chars / (n_chars + 1500.0) AS p, CAST(n_chars / (n_chars + 1500.0) >= 0.5 AS INTEGER) AS h FROM documents JOIN labels USING (doc_id))"
_FEATURES = ("downside_vol_20", "log_return", "momentum_20", "momentum_5", "simple_return", "vol_20", "vol_5", "vol_60", "vol_ratio_20_60", "vol_ratio_5_20")
#: Rows of a ticker before a feature has a value.
_BACK = {
    "downside_vol_20": 20, "log_return": 1, "momentum_20": 20, "momentum_5": 5, "simple_return": 1, "vol_20": 20, "vol_5": 5, "vol_60": 60,
    "vol_ratio_20_60": 60, "vol_ratio_5_20": 20,
}

QUERIES = {
    "regime_context": context, "regime_risks": risks, "regime_transition_analysis": transition_analysis, "regime_interpretation": interpretation,
    "model_report": report, "model_prediction_summary": prediction_summary, "model_feature_columns": feature_columns, "regime_feature_columns": regime_columns,
}

ORACLE_SQL = {
    "regime_context": f"""WITH {_LABELS}, b AS (SELECT t.ticker, t.date, t.r, coalesce(g.label, 'Unknown') AS label FROM t LEFT JOIN g ON t.ticker = g.ticker AND t.date = g.date),
        n AS (SELECT *, CASE WHEN label = lag(label) {OVER} THEN 0 ELSE 1 END AS new FROM b), u AS (SELECT *, sum(new) {OVER} AS run2, dense_rank() OVER (PARTITION BY ticker ORDER BY label) - 1 AS code,
          last_value(label) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM n), v AS (SELECT *, {_LEVEL('label')} AS level FROM u)
        SELECT ticker, date, round(r, 6) AS r, label AS regime_label, CAST(code AS INTEGER) AS regime_code, level AS risk_level, CAST(row_number() OVER (PARTITION BY ticker, run2 ORDER BY date) AS INTEGER) AS regime_duration,
        CAST(label = last AS INTEGER) AS current_flag, {_case('level', R.RISK_CODES, R.OTHER_CODE)} AS risk_code FROM v""",
    "regime_risks": f"""WITH {_LABELS}, a AS (SELECT label FROM g UNION ALL SELECT 'Other' FROM bars) SELECT label AS regime_label, {_LEVEL('label')} AS risk_level,
        {_case('label', [(x[0], x[2]) for x in R.RISKS], R.OTHER_RISK[1])}::DOUBLE AS adjustment, {_case('label', [(x[0], x[3]) for x in R.RISKS], R.OTHER_RISK[2])} AS meaning, count(*) AS n FROM a GROUP BY label""",
    "regime_transition_analysis": f"""WITH {_LABELS}, n AS (SELECT *, lead(label) {OVER} AS after FROM g), c AS (SELECT ticker, label AS before, after, count(*) AS n FROM n WHERE after IS NOT NULL GROUP BY 1, 2, 3),
        sh AS (SELECT *, n / sum(n) OVER (PARTITION BY ticker, before) AS share FROM c), q AS (SELECT DISTINCT a.ticker, a.before, b.after FROM sh a JOIN sh b USING (ticker)),
        z AS (SELECT q.*, coalesce(sh.share, 0) AS share FROM q LEFT JOIN sh USING (ticker, before, after)), w AS (SELECT ticker, arg_max(label, date) AS cur FROM g GROUP BY ticker),
        x AS (SELECT ticker, cur, arg_min(before, (-share, before)) FILTER (before = after) AS ms, max(share) FILTER (before = after) AS mp, arg_min(before, (share, before)) FILTER (before = after) AS ls,
          min(share) FILTER (before = after) AS lp, coalesce(max(share) FILTER (before = after AND before = cur), 0) AS stay, coalesce(arg_min(after, (-share, after)) FILTER (before = cur AND after <> cur), 'Unknown') AS nx,
          coalesce(max(share) FILTER (before = cur AND after <> cur), 0) AS np FROM z JOIN w USING (ticker) GROUP BY ticker, cur)
        SELECT ticker, cur AS current, ms AS most_stable, ls AS least_stable, nx AS next_likely, {sql(most_stable_share='mp', least_stable_share='lp', stay_share='stay', next_share='np')},
        printf('The most stable market environment is %s (%.1f%% chance to remain). Currently in %s, there is a %.1f%% probability of staying in this state tomorrow, and a %.1f%% probability of transitioning to %s.', ms, mp * 100, cur, stay * 100, np * 100, nx) AS interpretation FROM x""",
    "regime_interpretation": f"""WITH {_RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM u), w AS (SELECT ticker, arg_max(label, date) AS cur, arg_max(run2, date) AS last FROM b GROUP BY ticker),
        x AS (SELECT ticker, cur, count(*) FILTER (run2 = last) AS dur, avg(CAST(label = cur AS DOUBLE)) FILTER (back <= 20) AS pr, avg(r) FILTER (label = cur) * 252 AS m, stddev_samp(r) FILTER (label = cur) * sqrt(252) AS v,
          avg(CAST(r > 0 AS DOUBLE)) FILTER (label = cur) AS h FROM b JOIN w USING (ticker) GROUP BY ticker, cur)
        SELECT ticker, cur AS label, printf('The ticker %s is currently classified as **%s** with %s and a %d-day regime duration. ', ticker, cur, CASE WHEN pr >= 0.8 THEN 'high assignment probability' WHEN pr >= 0.5 THEN 'moderate assignment probability' ELSE 'low assignment probability' END, dur)
        || printf('Historically, this regime has shown %s annualized returns (%.1f%%), %s volatility (%.1f%%), and a %.1f%% positive-day rate. ', CASE WHEN m > 0 THEN 'positive' ELSE 'negative' END, m * 100, CASE WHEN v > 0.25 THEN 'high' WHEN v > 0.12 THEN 'moderate' ELSE 'low' END, v * 100, h * 100)
        || {_case('cur', R.COMMENTS, '')} || '{R.WARNING}' AS text FROM x""",
    "model_report": f"""WITH {_Y}, c AS (SELECT c, count(*) FILTER (y = c AND h = c) AS hit, count(*) FILTER (y = c) AS support, count(*) FILTER (h = c) AS said FROM d, (SELECT DISTINCT unnest([y, h]) AS c FROM d) GROUP BY c),
        e AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM e)
        SELECT CAST(c AS VARCHAR) AS class, {sql(precision='p', recall='r', f1='f', support='support::DOUBLE')} FROM f UNION ALL
        SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6) FROM f UNION ALL
        SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::DOUBLE FROM f UNION ALL
        SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::DOUBLE FROM f""",
    "model_prediction_summary": f"WITH {_Y} SELECT {sql(average_prediction='avg(h)', positive_rate='avg(CAST(h = 1 AS DOUBLE))', average_confidence='avg(p)::DOUBLE')} FROM d",
    "model_feature_columns": f"""WITH {WEEKLY}, k AS (SELECT ticker, count(*) AS c FROM bars GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS position, name, CAST(sum(greatest(c - back, 0)) AS BIGINT) AS n
        FROM k, (VALUES {', '.join(f'({i}, {n!r}, {_BACK[n]})' for i, n in enumerate(_FEATURES))}) t(i, name, back) GROUP BY 1, 2""",
    "regime_feature_columns": "SELECT CAST(i AS INTEGER) AS position, n AS name FROM (VALUES (0, 'log_return'), (1, 'rolling_return_20'), (2, 'drawdown_from_252_high')) t(i, n)",
}
