"""Queries of models, regimes, optimal weights and simulations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.windows import change, rounded
from tidemark.operators import features as X
from tidemark.operators import hidden_markov as H
from tidemark.operators import learn as L
from tidemark.operators import optimize as O
from tidemark.operators import simulate as M
from tidemark.operators import stats as S
from tidemark.operators import walk_forward as W
from tidemark.operators import wide_portfolios as B
from tidemark.plans.sql import BLOCKS, LAGGED, OVER, WEEKLY, out, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import table, weekly_bars

FEATURES = ["simple_return", "momentum_5", "vol_5", "volume_change"]


def _rows(spark, d):
    rows = X.volatility(X.momentum(X.returns(weekly_bars(spark, d)), (5,)), (5, 20, 60))
    return X.targets(rows.withColumn("volume_change", change("volume"))).withColumn("y", F.col("direction"))


def _regime_rows(spark, d):
    return X.volatility(X.returns(S.with_returns(weekly_bars(spark, d))), (5, 20, 60)).withColumn("vol", F.col("vol_20"))


def chronological(spark, d):
    rows = L.chronological(weekly_bars(spark, d))
    return rows.groupBy("ticker", "train").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def suite(spark, d):
    return L.suite(_rows(spark, d), FEATURES)


def walk_forward(spark, d):
    return L.scores(L.walk_forward(_rows(spark, d), FEATURES), ["ticker"])


def folds(spark, d):
    """Borders and rows of the folds of each ticker's bars, and of all bars together by date."""
    bars = weekly_bars(spark, d)
    return W.folds(bars).unionByName(W.folds(bars, together=True, step=40))


def forward_models(spark, d):
    """Scores of two classifiers over folds by date of all tickers."""
    rows, parts = _rows(spark, d), []
    for model in ("logistic", "random_forest"):
        parts.append(W.walk_forward(rows, FEATURES, model, step=60, together=True).withColumn("model", F.lit(model)))
    return L.scores(parts[0].unionByName(parts[1]), ["model", "fold"])


def forward_regression(spark, d):
    """Errors of a linear model of the next return over folds by date."""
    found = W.walk_forward(_next_return(spark, d), FEATURES, "linear_regression", kind="regression", step=60, together=True)
    return L.regression_scores(found, "y", "prediction")


def _labelled(spark, d):
    """The label of quality against a score by length: long texts tend to be good."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))


def scores(spark, d):
    out = L.scores(_labelled(spark, d).withColumn("g", F.lit("all")), ["g"])
    return out.select("g", "n", *[rounded(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "brier", "auc", "baseline")])


def thresholds(spark, d):
    out = L.thresholds(_labelled(spark, d))
    return out.select("threshold", "signals", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


def _next_return(spark, d):
    return _rows(spark, d).drop("y").withColumn("y", F.col("future_return"))


def linear(spark, d):
    """Coefficients of the next return on two features, by the normal equations."""
    rows = _next_return(spark, d)
    return out(L.importance(L.fitted(rows, ["simple_return", "momentum_5"], L.regressors()["linear_regression"]), ["simple_return", "momentum_5"], spark), 5)


def regression_suite(spark, d):
    return L.regression_suite(_next_return(spark, d), FEATURES)


def regression(spark, d):
    """The next return foretold by the last one."""
    rows = X.targets(X.returns(weekly_bars(spark, d))).select("future_return", "simple_return").dropna()
    out = L.regression_scores(rows, "future_return", "simple_return")
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def kmeans(spark, d):
    return L.label_regimes(L.cluster_regimes(_regime_rows(spark, d), ["log_return", "vol_20", "dd"])).select("ticker", "date", "state", "regime")


def mixture(spark, d):
    return L.cluster_regimes(_regime_rows(spark, d), ["log_return", "vol_20", "dd"], 3, mixture=True).select("ticker", "date", "state", "state_probability")


def hidden_markov(spark, d):
    """States of a hidden Markov model with full covariances, fitted to each ticker."""
    rows = H.detected(_regime_rows(spark, d), ["log_return", "vol_20"], 3, **BLOCKS)
    return rows.select("ticker", "date", "state", "state_probability")


def regime_models(spark, d):
    """Share and mean probability of each state under each kind of model."""
    rows = _regime_rows(spark, d)
    parts = [L.regimes(rows, ["log_return", "vol_20"], model, 3, **BLOCKS) for model in ("hmm", "gmm", "kmeans")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("model", "ticker", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("state_probability").alias("probability"))


#: A chain that is given, not fitted: falling, calm and rising weeks, by log return and volatility of five weeks.
CHAIN = H.Chain(
    np.array([0.3, 0.4, 0.3]),
    np.array([[0.3, 0.2, 0.5], [0.1, 0.8, 0.1], [0.5, 0.2, 0.3]]),
    np.array([[-0.09, 2.0], [0.0, 1.2], [0.09, 2.0]]),
    np.array([[[0.005, -0.008], [-0.008, 0.2]], [[0.006, 0.002], [0.002, 0.15]], [[0.006, 0.01], [0.01, 0.2]]]),
)


def viterbi(spark, d):
    """The likeliest path of each ticker through the states of a given chain."""
    rows = _blocks(spark, d, lambda bars: X.volatility(X.returns(bars), (5, 20, 60)), 61).select("ticker", "date", "log_return", "vol_5")
    chains = rows.select("ticker").distinct().withColumn("numbers", F.lit(CHAIN.flat()))
    return H.decode(rows, ["log_return", "vol_5"], chains, **BLOCKS).select("ticker", "date", "state")


def _blocks(spark, d, f, back):
    return X.in_blocks(weekly_bars(spark, d), f, back=back, **BLOCKS)


def _viterbi_sql() -> str:
    """Scores forward by one recursion, the path back by another."""
    states, best, origin, density = range(3), [], [], []
    for mean, covariance in zip(CHAIN.means, CHAIN.covariances):
        inverse = np.linalg.inv(covariance)
        constant = -np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(covariance))
        x, y = f"(x - {float(mean[0])!r})", f"(y - {float(mean[1])!r})"
        square = f"{float(inverse[0, 0])!r} * {x} * {x} + 2 * {float(inverse[0, 1])!r} * {x} * {y} + {float(inverse[1, 1])!r} * {y} * {y}"
        density.append(f"{float(constant)!r} - 0.5 * ({square})")
    turn = np.log(CHAIN.transition)
    for j in states:
        ways = [f"s{i} + {float(turn[i, j])!r}" for i in states]
        best.append(f"greatest({', '.join(ways)}) + o.b{j} AS s{j}")
        origin.append(f"CASE WHEN {ways[0]} >= greatest({ways[1]}, {ways[2]}) THEN 0 WHEN {ways[1]} >= {ways[2]} THEN 1 ELSE 2 END AS f{j}")
    first = ", ".join(f"b{j} + {float(np.log(CHAIN.start[j]))!r} AS s{j}" for j in states)
    return f"""WITH RECURSIVE {LAGGED}, v AS (SELECT ticker, date, log_return AS x, {rolling('stddev_samp', 'log_return', 5)} * sqrt(252) AS y FROM r),
      o AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n,
        {', '.join(f'{q} AS b{j}' for j, q in enumerate(density))} FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
      f AS (SELECT ticker, i, {first}, -1 AS f0, -1 AS f1, -1 AS f2 FROM o WHERE i = 1
        UNION ALL SELECT o.ticker, o.i, {', '.join(best)}, {', '.join(origin)} FROM f JOIN o ON o.ticker = f.ticker AND o.i = f.i + 1),
      p AS (SELECT o.ticker, o.i, CASE WHEN s0 >= greatest(s1, s2) THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS state
          FROM o JOIN f ON f.ticker = o.ticker AND f.i = o.i WHERE o.i = o.n
        UNION ALL SELECT f.ticker, f.i - 1, CASE p.state WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END FROM p JOIN f ON f.ticker = p.ticker AND f.i = p.i
          WHERE f.i > 1)
      SELECT o.ticker, o.date, p.state FROM o JOIN p ON p.ticker = o.ticker AND p.i = o.i"""


def weights(spark, d):
    bars = weekly_bars(spark, d)
    means = S.with_returns(bars).groupBy("ticker").agg((F.avg("r") * 252).alias("mu"))
    return out(O.compared(spark, means, S.covariances(bars)))


def weights_in_blocks(spark, d):
    """As weights, by products with a matrix that stays in Spark."""
    bars = weekly_bars(spark, d)
    means = S.with_returns(bars).groupBy("ticker").agg((F.avg("r") * 252).alias("mu"))
    return out(B.compared(means, S.covariances(bars), side=2))


def market_of(spark, d):
    """(start, mu, sigma) of all bars: the mean close, and mean and deviation of weekly returns, of a year."""
    rows = X.returns(weekly_bars(spark, d))
    r = F.col("simple_return")
    one = rows.agg(F.round(F.avg("close"), 2).alias("s"), F.round(F.avg(r) * 52, 4).alias("m"), F.round(F.stddev_samp(r) * 52**0.5, 4).alias("v")).first()
    return one.s, one.m, one.v


def _paths(spark, d):
    """A year of weeks, 4,000 times, and where they start."""
    start, mu, sigma = market_of(spark, d)
    return M.paths(spark, start, mu, sigma, 1.0, 52, 4000), start


def simulation(spark, d):
    return out(M.summary(*_paths(spark, d)), 4)


def simulation_bands(spark, d):
    return out(M.bands(_paths(spark, d)[0]), 4)


def simulation_densities(spark, d):
    return out(M.densities(_paths(spark, d)[0]), 6)


_Y = "d AS (SELECT quality AS y, n_chars / (n_chars + 1500.0) AS p FROM documents JOIN labels USING (doc_id))"

QUERIES = {
    "model_split": chronological, "model_suite": suite, "model_walk_forward": walk_forward, "model_folds": folds, "model_forward_models": forward_models, "model_forward_regression": forward_regression, "model_scores": scores, "model_thresholds": thresholds, "model_regression": regression, "model_importance": linear, "model_regression_suite": regression_suite,
    "regime_kmeans": kmeans, "regime_mixture": mixture, "regime_hidden_markov": hidden_markov, "regime_models": regime_models, "regime_viterbi": viterbi, "portfolio_weights": weights, "portfolio_weights_in_blocks": weights_in_blocks,
    "simulate_summary": simulation, "simulate_bands": simulation_bands, "simulate_densities": simulation_densities,
}

ORACLE_SQL = {
    "model_folds": f"""WITH {WEEKLY}, a AS (SELECT ticker AS "group", date, 30 AS step FROM bars UNION ALL SELECT 'all', date, 40 FROM bars),
        p AS (SELECT *, dense_rank() OVER (PARTITION BY "group" ORDER BY date) - 1 AS place FROM a),
        n AS (SELECT "group", any_value(step) AS step, max(place) + 1 AS n, CAST(floor((max(place) + 1) * 0.6) AS BIGINT) AS start FROM p GROUP BY 1),
        f AS (SELECT n.*, k AS fold, start + k * step AS cut FROM n, range(100) r(k) WHERE start + k * step < n)
        SELECT f."group", CAST(fold AS INTEGER) AS fold, count(*) FILTER (place < cut) AS train_rows, count(*) FILTER (place >= cut) AS test_rows,
          min(date) FILTER (place < cut) AS train_first, max(date) FILTER (place < cut) AS train_last,
          min(date) FILTER (place >= cut) AS test_first, max(date) FILTER (place >= cut) AS test_last
        FROM f JOIN p ON p."group" = f."group" AND place < cut + f.step GROUP BY 1, 2""",
    "regime_viterbi": _viterbi_sql(),
    "model_split": f"""WITH {WEEKLY}, k AS (SELECT *, row_number() {OVER} <= floor(count(*) OVER (PARTITION BY ticker) * (1 - 0.2::DOUBLE)) AS train FROM bars)
        SELECT ticker, train, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM k GROUP BY 1, 2""",
    "model_scores": f"""WITH {_Y}, r AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS h, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM d),
        g AS (SELECT count(*) AS n, avg(CAST(h = y AS DOUBLE)) AS a, sum(h * y) / nullif(sum(h), 0) AS pr, sum(h * y) / nullif(sum(y), 0) AS re, avg(pow(p - y, 2)) AS b,
        (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, greatest(avg(y), 1 - avg(y)) AS base FROM r)
        SELECT 'all' AS g, n, {sql(accuracy='a', precision='pr', recall='re', f1='2 * pr * re / nullif(pr + re, 0)', brier='b', auc='auc', baseline='base')} FROM g""",
    "model_thresholds": f"""WITH {_Y} SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS threshold, CAST(sum(CAST(p >= round(0.5 + 0.05 * k, 2) AS INTEGER)) AS BIGINT) AS signals, round(sum(CASE WHEN p >= round(0.5 + 0.05 * k, 2) THEN y ELSE 0 END) / nullif(sum(CAST(p >= round(0.5 + 0.05 * k, 2) AS INTEGER)), 0), 6)::DOUBLE AS precision,
        round(sum(CASE WHEN p >= round(0.5 + 0.05 * k, 2) THEN y ELSE 0 END) / sum(y), 6)::DOUBLE AS recall FROM d, range(9) t(k) GROUP BY k""",
    "model_importance": f"""WITH {LAGGED}, f AS (SELECT lead(close) {OVER} / close - 1 AS y, simple_return AS a, close / lag(close, 5) {OVER} - 1 AS b FROM r), e AS (SELECT * FROM f WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
        m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy FROM e), k AS (SELECT unnest(['simple_return', 'momentum_5']) AS feature, unnest([(ay * bb - cy * ab) / (aa * bb - ab * ab), (cy * aa - ay * ab) / (aa * bb - ab * ab)]) AS v FROM m)
        SELECT CAST(row_number() OVER (ORDER BY abs(v) DESC) AS INTEGER) AS rank, feature, round(v, 5) AS importance FROM k""",
    "model_regression": f"""WITH {LAGGED}, f AS (SELECT lead(close) {OVER} / close - 1 AS y, simple_return AS p FROM r), e AS (SELECT * FROM f WHERE y IS NOT NULL AND p IS NOT NULL)
        SELECT {sql(mae='avg(abs(y - p))', rmse='sqrt(avg(pow(y - p, 2)))', r2='1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y))', direction='avg(CAST(sign(y) = sign(p) AS DOUBLE))')} FROM e""",
}
