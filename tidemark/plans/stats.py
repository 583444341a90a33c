"""Queries of summary statistics and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, change, rolling as roll, rounded
from tidemark.operators import features as X
from tidemark.operators import stats as S
from tidemark.plans.sql import BENCH, LAGGED, OVER, WEEKLY, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import benchmark, table, weekly_bars

SECTORS = (("A", "Growth"), ("N", "Value"))
WEIGHTS = (("A", 2.0), ("N", 1.0), ("R", 1.0))


def _out(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _literal(spark, rows, schema):
    names = [x.split()[0] for x in schema.split(",")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def _weights(spark, total=4.0):
    return _literal(spark, [(t, w / total) for t, w in WEIGHTS], "ticker string,w double")


def summary(spark, d):
    bars = weekly_bars(spark, d)
    return _out(S.summary(bars, benchmark(bars)))


def risk_summary(spark, d):
    return _out(S.risk_summary(weekly_bars(spark, d)))


def sectors(spark, d):
    return _out(S.by_sector(S.summary(weekly_bars(spark, d)), _literal(spark, SECTORS, "ticker string,sector string")))


def quality(spark, d):
    return _out(S.quality(weekly_bars(spark, d)))


def missing(spark, d):
    return S.missing_values(table(spark, d, "events"))


def correlations(spark, d):
    return _out(S.correlations(weekly_bars(spark, d)))


def extreme_pairs(spark, d):
    return _out(S.extreme_pairs(S.correlations(weekly_bars(spark, d))))


def value_at_risk(spark, d):
    return _out(S.value_at_risk(weekly_bars(spark, d)))


def episodes(spark, d):
    return _out(S.drawdown_episodes(weekly_bars(spark, d)))


def _trend(spark, d):
    return X.trend(S.with_returns(weekly_bars(spark, d)))


def regime_runs(spark, d):
    return S.runs(_trend(spark, d), "trend").drop("run")


def regime_transitions(spark, d):
    return _out(S.transitions(_trend(spark, d), "trend"))


def regime_performance(spark, d):
    return _out(S.label_performance(_trend(spark, d), "trend"))


def regime_current(spark, d):
    """Last label per ticker, the length of its run, switches in the last 20 rows, and how stable that is."""
    from tidemark.functions.windows import run_starts

    rows = _trend(spark, d).withColumn("run", run_starts("trend", by_date()))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    out = rows.groupBy("ticker").agg(
        F.max_by("trend", "date").alias("trend"), F.max("date").alias("date"),
        (F.max(F.when(F.col("back") <= 20, F.col("run"))) - F.min(F.when(F.col("back") <= 20, F.col("run")))).alias("switches"), F.max("run").alias("run"),
    )
    length = rows.groupBy("ticker", "run").agg(F.count(F.lit(1)).alias("duration"))
    return out.join(length, ["ticker", "run"]).select("ticker", "date", "trend", "duration", "switches", F.when(F.col("switches") <= 2, "High").when(F.col("switches") <= 4, "Medium").otherwise("Low").alias("stability"))


def portfolio(spark, d):
    return _out(S.portfolio(weekly_bars(spark, d), _weights(spark)))


def covariances(spark, d):
    return _out(S.covariances(weekly_bars(spark, d)))


def risk_contributions(spark, d):
    return _out(S.risk_contributions(S.covariances(weekly_bars(spark, d)), _weights(spark)))


def _pair(spark, d):
    rows = S.with_returns(weekly_bars(spark, d)).filter(F.col("r").isNotNull())
    a, b = (rows.filter(F.col("ticker") == t).select("date", F.col("r").alias(n)) for t, n in (("A", "ra"), ("N", "rb")))
    return a.join(b, "date").withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # two tickers, one row per date


def link(spark, d):
    """Slope, intercept, share explained and residual deviation of one ticker's returns on another's; needs 30 dates."""
    p = _pair(spark, d)
    n = F.count(F.lit(1))
    r2 = F.pow(F.corr("ra", "rb"), 2)
    resid = F.sqrt(F.var_samp("rb") * (1 - r2) * (n - 1) / (n - 2))
    return _out(p.agg(n.alias("n"), F.regr_slope("rb", "ra").alias("beta"), F.regr_intercept("rb", "ra").alias("alpha"), r2.alias("r2"), resid.alias("residual")).filter("n >= 30"))


def lead_lag(spark, d):
    return _out(S.lead_lag(_pair(spark, d)))


def histogram(spark, d):
    """Twenty equal bins of each ticker's returns from the least to the greatest, the last one closed."""
    rows = S.with_returns(weekly_bars(spark, d)).filter(F.col("r").isNotNull())
    ends = rows.groupBy("ticker").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    bin_ = F.least(F.lit(19), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20)).cast("int")
    return rows.join(ends, "ticker").groupBy("ticker", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hit_rate(spark, d):
    """Share of the last 60 rows whose direction the sign of the 5-row momentum of the row before foretold."""
    rows = S.with_returns(weekly_bars(spark, d)).withColumn("p", change("close", 5)).withColumn("p", F.lag("p").over(by_date()))
    rows = rows.withColumn("hit", F.when(F.col("p").isNotNull(), (F.signum("p") == F.signum("r")).cast("double")))
    return _out(rows.select("ticker", "date", roll(F.avg, "hit", 60).alias("hit_rate")))


_R = f"{WEEKLY}, {BENCH}, t AS (SELECT bars.*, close / lag(close) {OVER} - 1 AS r, close / max(close) {OVER} - 1 AS dd FROM bars)"
_RB = f"{_R}, tb AS (SELECT t.*, bench_close / lag(bench_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS b FROM t LEFT JOIN bench USING (date))"
_SUMMARY = f"""{_RB}, g AS (SELECT ticker, count(close) AS n, arg_max(close, date) / arg_min(close, date) AS q, date_diff('day', min(date), max(date)) AS days, avg(r) AS m, max(r) AS hi, min(r) AS lo,
  stddev_samp(r) AS sd, sqrt(avg(r * r) FILTER (r < 0)) * sqrt(252) AS dn, min(dd) AS mdd, covar_samp(r, b) / var_samp(b) AS beta, avg(b) * 252 AS market FROM tb GROUP BY ticker)"""
_TREND = f"""{_R}, s AS (SELECT *, {rolling('avg', 'close', 50)} AS x, {rolling('avg', 'close', 200)} AS y FROM t),
  l AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN 'Unknown' WHEN close > x AND x > y THEN 'Bullish' WHEN close < x AND x < y THEN 'Bearish' ELSE 'Neutral' END AS trend FROM s),
  f AS (SELECT *, CASE WHEN trend = lag(trend) {OVER} THEN 0 ELSE 1 END AS new FROM l), k AS (SELECT *, sum(new) {OVER} AS run FROM f)"""
_W = "w(ticker, w) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.25), ('R', 0.25))"
_COV = f"{_R}, {_W}, cov AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.r, b.r) * 252 AS cov FROM t a JOIN t b USING (date) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)"
_PAIR = f"{_R}, p AS (SELECT a.r AS ra, b.r AS rb, row_number() OVER (ORDER BY date) AS i FROM t a JOIN t b USING (date) WHERE a.ticker = 'A' AND b.ticker = 'N' AND a.r IS NOT NULL AND b.r IS NOT NULL)"
_CORR = f"{_R}, c AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS corr, count(*) AS n FROM t a JOIN t b USING (date) WHERE a.ticker < b.ticker AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)"
_Z, _D = S.Z[0.95], S.DENSITY[0.95]

QUERIES = {
    "stats_summary": summary, "stats_risk_summary": risk_summary, "stats_sectors": sectors, "stats_quality": quality, "stats_missing": missing,
    "stats_correlations": correlations, "stats_extreme_pairs": extreme_pairs, "stats_value_at_risk": value_at_risk, "stats_drawdown_episodes": episodes,
    "stats_histogram": histogram, "stats_hit_rate": hit_rate, "regime_runs": regime_runs, "regime_transitions": regime_transitions, "regime_performance": regime_performance,
    "regime_current": regime_current, "portfolio_risk": portfolio, "portfolio_covariances": covariances, "portfolio_contributions": risk_contributions,
    "join_link": link, "join_lead_lag": lead_lag,
}

ORACLE_SQL = {
    "stats_summary": f"""WITH {_SUMMARY} SELECT ticker, n, {sql(total_return='q - 1', cagr='pow(q, 365.25 / days) - 1', annualized_return='pow(q, 252.0 / n) - 1', mean='m', best='hi', worst='lo',
        downside_deviation='dn', max_drawdown='mdd', beta='beta', volatility='sd * sqrt(252)', sharpe='(m * 252 - 0.05) / (sd * sqrt(252))', sortino='(m * 252 - 0.05) / dn', capm='0.05 + beta * (market - 0.05)')} FROM g""",
    "stats_risk_summary": f"""WITH {_SUMMARY} SELECT ticker, {sql(volatility='sd * sqrt(252)', downside_deviation='dn', max_drawdown='mdd')},
        CASE WHEN sd * sqrt(252) < 0.15 THEN 'Low' WHEN sd * sqrt(252) <= 0.3 THEN 'Medium' ELSE 'High' END AS risk_class FROM g""",
    "stats_sectors": f"""WITH {_SUMMARY}, x AS (SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS tickers, avg(q - 1) AS r, avg(sd * sqrt(252)) AS v, avg(mdd) AS m FROM g
        LEFT JOIN (VALUES ('A', 'Growth'), ('N', 'Value')) s(ticker, sector) USING (ticker) WHERE n >= 2 GROUP BY 1)
        SELECT sector, tickers, {sql(total_return='r', volatility='v', max_drawdown='m')}, CAST(row_number() OVER (ORDER BY r DESC, sector) AS INTEGER) AS rank FROM x""",
    "stats_quality": f"""WITH {WEEKLY} SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, CAST(5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume) AS BIGINT) AS missing,
        count(*) - count(DISTINCT date) AS repeated_dates, round(100.0 * (count(open) + count(high) + count(low) + count(close) + count(volume)) / (5 * count(*)), 6) AS completeness FROM bars GROUP BY ticker""",
    "stats_missing": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "stats_correlations": f"WITH {_CORR} SELECT a, b, round(corr, 6) AS corr, n FROM c",
    "stats_extreme_pairs": f"WITH {_CORR} (SELECT 'highest' AS kind, a, b, round(corr, 6) AS corr FROM c ORDER BY c.corr DESC, a, b LIMIT 1) UNION ALL (SELECT 'lowest', a, b, round(corr, 6) FROM c ORDER BY c.corr, a, b LIMIT 1)",
    "stats_value_at_risk": f"""WITH {_R}, m AS (SELECT ticker, quantile_cont(r, 0.05) AS q, avg(r) AS mu, stddev_samp(r) AS sd FROM t GROUP BY ticker),
        h AS (SELECT t.ticker, avg(r) FILTER (r <= q) AS tail, avg(pow(r - mu, 3)) / pow(any_value(sd), 3) AS s, avg(pow(r - mu, 4)) / pow(any_value(sd), 4) - 3 AS k FROM t JOIN m USING (ticker) WHERE r IS NOT NULL GROUP BY t.ticker)
        SELECT ticker, {sql(historical_var='greatest(0, -q)', historical_cvar='greatest(0, -tail)', parametric_var=f'greatest(0, {_Z} * sd - mu)', parametric_cvar=f'greatest(0, sd * {_D} / 0.05 - mu)',
        cornish_fisher_var=f'({_Z} + ({_Z} * {_Z} - 1) * s / 6 + (pow({_Z}, 3) - 3 * {_Z}) * k / 24 - (2 * pow({_Z}, 3) - 5 * {_Z}) * s * s / 36) * sd - mu', var_10=f'{_Z} * sd * sqrt(10) - 10 * mu')} FROM m JOIN h USING (ticker)""",
    "stats_drawdown_episodes": f"""WITH {WEEKLY}, p AS (SELECT *, max(close) {OVER} AS peak FROM bars), e AS (SELECT *, sum(CASE WHEN close = peak THEN 1 ELSE 0 END) {OVER} AS ep FROM p),
        g AS (SELECT ticker, ep, min(date) AS peak_date, arg_min(date, close / peak) AS trough_date, min(close / peak - 1) AS depth, count(*) AS length FROM e GROUP BY 1, 2),
        x AS (SELECT *, lead(peak_date) OVER (PARTITION BY ticker ORDER BY ep) AS recovery_date FROM g),
        q AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY depth, peak_date) AS INTEGER) AS rank FROM x WHERE depth < 0)
        SELECT ticker, rank, peak_date, trough_date, recovery_date, round(depth, 6) AS depth, length FROM q WHERE rank <= 5""",
    "stats_histogram": f"""WITH {_R}, e AS (SELECT ticker, min(r) AS lo, max(r) AS hi FROM t GROUP BY ticker)
        SELECT ticker, CAST(least(19, floor((r - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM t JOIN e USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2""",
    "stats_hit_rate": f"""WITH {_R}, a AS (SELECT *, close / lag(close, 5) {OVER} - 1 AS m FROM t), b AS (SELECT *, lag(m) {OVER} AS p FROM a), c AS (SELECT *, CASE WHEN p IS NOT NULL THEN CAST(sign(p) = sign(r) AS DOUBLE) END AS hit FROM b)
        SELECT ticker, date, round({rolling('avg', 'hit', 60)}, 6) AS hit_rate FROM c""",
    "regime_runs": f"WITH {_TREND} SELECT ticker, any_value(trend) AS trend, min(date) AS first_date, max(date) AS last_date, count(*) AS length FROM k GROUP BY ticker, run",
    "regime_transitions": f"""WITH {_TREND}, n AS (SELECT ticker, trend AS before, lead(trend) {OVER} AS after FROM l), c AS (SELECT ticker, before, after, count(*) AS n FROM n WHERE after IS NOT NULL GROUP BY 1, 2, 3)
        SELECT ticker, before, after, n, round(n / sum(n) OVER (PARTITION BY ticker, before), 6) AS share FROM c""",
    "regime_performance": f"""WITH {_TREND}, g AS (SELECT ticker, trend, count(*) AS n, avg(r) * 252 AS m, stddev_samp(r) * sqrt(252) AS v, min(dd) AS w, avg(CAST(r > 0 AS DOUBLE)) AS h FROM l GROUP BY 1, 2)
        SELECT ticker, trend, n, {sql(mean='m', volatility='v', worst_drawdown='w', hit_rate='h', sharpe='m / nullif(v, 0)')} FROM g""",
    "regime_current": f"""WITH {_TREND}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY ticker, run) AS len FROM k),
        g AS (SELECT ticker, max(date) AS date, arg_max(trend, date) AS trend, arg_max(len, date) AS duration, CAST(max(run) FILTER (back <= 20) - min(run) FILTER (back <= 20) AS BIGINT) AS switches FROM b GROUP BY ticker)
        SELECT *, CASE WHEN switches <= 2 THEN 'High' WHEN switches <= 4 THEN 'Medium' ELSE 'Low' END AS stability FROM g""",
    "portfolio_risk": f"""WITH {_R}, {_W}, p AS (SELECT date, sum(w * r) AS r FROM t JOIN w USING (ticker) WHERE r IS NOT NULL GROUP BY date HAVING count(*) = 3),
        v AS (SELECT *, product(1 + r) OVER (ORDER BY date) AS value FROM p), x AS (SELECT *, value / max(value) OVER (ORDER BY date) - 1 AS dd FROM v)
        SELECT {sql(mean='avg(r) * 252', volatility='stddev_samp(r) * sqrt(252)', max_drawdown='min(dd)', var='greatest(0, -quantile_cont(r, 0.05))', sharpe='(avg(r) * 252 - 0.05) / (stddev_samp(r) * sqrt(252))')}, count(*) AS n FROM x""",
    "portfolio_covariances": f"WITH {_COV} SELECT i, j, round(cov, 6) AS cov FROM cov",
    "portfolio_contributions": f"""WITH {_COV}, s AS (SELECT i, a.w AS wi, sum(b.w * cov) AS s FROM cov JOIN w a ON a.ticker = i JOIN w b ON b.ticker = j GROUP BY 1, 2), v AS (SELECT *, sqrt(sum(wi * s) OVER ()) AS v FROM s)
        SELECT i AS ticker, {sql(w='wi', marginal='s / v', contribution='wi * s / v', share='wi * s / (v * v)')} FROM v""",
    "join_link": f"WITH {_PAIR} SELECT count(*) AS n, {sql(beta='regr_slope(rb, ra)', alpha='regr_intercept(rb, ra)', r2='regr_r2(rb, ra)', residual='sqrt(var_samp(rb) * (1 - regr_r2(rb, ra)) * (count(*) - 1) / (count(*) - 2))')} FROM p",
    "join_lead_lag": f"""WITH {_PAIR}, c AS (SELECT CAST(l AS INTEGER) AS lag, corr(a.ra, b.rb) AS c, count(*) AS n FROM p a, range(-5, 6) x(l), p b WHERE b.i = a.i + l GROUP BY 1)
        SELECT lag, round(c, 6) AS corr, n, lag = arg_max(lag, (abs(c), -lag)) OVER () AS strongest FROM c""",
}
