"""Queries of wide tables, exposures, weights, frontiers and books."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_sql
from tidemark.operators import optimize as O
from tidemark.operators import portfolio as P
from tidemark.operators import stats as S
from tidemark.plans.sql import BENCH, OVER, WEEKLY, out
from tidemark.plans.sql import rounded as sql
from tidemark.plans.stats import _W, _literal, _weights
from tidemark.sources.bars import table, weekly_bars

TICKERS = ["A", "N", "R"]
SPAN = ("1994-01-01", "1996-12-31")
TARGETS = 20


def returns_pivot(spark, d):
    return out(P.returns_pivot(weekly_bars(spark, d), TICKERS))


def price_pivot(spark, d):
    return out(P.price_pivot(weekly_bars(spark, d), TICKERS))


def correlations_between(spark, d):
    return out(S.correlations(P.between(weekly_bars(spark, d), *SPAN)))


def exposures(spark, d):
    return out(P.factor_exposures(P.returns_pivot(weekly_bars(spark, d), TICKERS), "A", ["N", "R"]))


def weight_checks(spark, d):
    """A book of segments by their part of all orders' worth, one of them held short: it sums to less than one."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    worth = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("c_mktsegment").alias("ticker")).agg(F.sum("o_totalprice").alias("v"))
    total = worth.agg(F.sum("v").alias("all"))
    share = F.round(F.col("v") / total.scalar(), 4)
    return out(P.weight_checks(worth.select("ticker", F.when(F.col("ticker") == "BUILDING", -share).otherwise(share).alias("w")), 3))


def _moments(spark, d):
    bars = weekly_bars(spark, d)
    return S.with_returns(bars).groupBy("ticker").agg((F.avg("r") * 252).alias("mu")), S.covariances(bars)


def performance(spark, d):
    return out(P.performance(_weights(spark), *_moments(spark, d)))


def frontier(spark, d):
    means, cov = _moments(spark, d)
    names, sigma = O.matrix(cov)
    mu_of = {r.ticker: r.mu for r in means.limit(O.MOST_ASSETS).collect()}
    return out(P.efficient_frontier(spark, names, np.array([mu_of[n] for n in names]), sigma, TARGETS))


def _book(spark, d):
    """Customers as positions: the class by segment, symbol by nation, market value by balance, the rest by key."""
    k = F.col("c_custkey")
    cls = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "EQUITY").when(F.col("c_mktsegment") == "FURNITURE", "COMMODITY").otherwise("OPTION")
    symbol = F.get(F.array(*map(F.lit, ("CL", "NG", "GC", "SI", "HG"))), (F.col("c_nationkey") % 5).cast("int"))
    option = lambda c: F.when(cls == "OPTION", c)
    return table(spark, d, "customer").select(
        "c_custkey", cls.alias("cls"), symbol.alias("symbol"), F.col("c_acctbal").alias("mv"), (0.1 + (k % 7) * 0.05).alias("vol"), F.when(k % 3 > 0, 0.5 + (k % 5) * 0.25).alias("beta"),
        option((k % 11 - 5) / 10.0).alias("delta"), option((k % 4) / 100.0).alias("gamma"), option((k % 6) / 10.0).alias("vega"), option(-(k % 3) / 10.0).alias("theta"),
    )


def net_greeks(spark, d):
    return out(P.net_greeks(_book(spark, d)))


def book_sigma(spark, d):
    return out(P.book_sigma(_book(spark, d)))


def book_value_at_risk(spark, d):
    return out(P.book_value_at_risk(spark, _book(spark, d)), 4)


def scenario_losses(spark, d):
    return out(P.scenario_losses(_book(spark, d)).select("c_custkey", "scenario", "pnl"), 8)


def _orders_as_books(spark, d):
    """Orders as books whose positions are their lines; the quantity of every seventh part is 0."""
    zero = F.when(F.col("l_partkey") % 7 == 0, 0.0).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat(F.lit(" s"), F.col("l_partkey") % 50).alias("symbol"), zero.alias("quantity"))


def checked_positions(spark, d):
    return P.checked_positions(_orders_as_books(spark, d))


def replaced_positions(spark, d):
    """Per order the sum of its positions after orders of even key sent new ones of twice the quantity."""
    stored = _orders_as_books(spark, d)
    new = stored.filter("owner % 2 = 0").withColumn("quantity", F.col("quantity") * 2)
    return P.replaced_positions(stored, new).groupBy("owner").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


_WIDE = f"""{WEEKLY}, p AS (SELECT date, {", ".join(f"max(close) FILTER (ticker = '{t}') AS {t}" for t in TICKERS)} FROM bars GROUP BY date)"""
_RET = f"{_WIDE}, x AS (SELECT date, {', '.join(f'{t} / lag({t}) OVER (ORDER BY date) - 1 AS {t}' for t in TICKERS)} FROM p)"
_MU = f"""{WEEKLY}, t AS (SELECT *, close / lag(close) {OVER} - 1 AS r FROM bars), mu AS (SELECT ticker, avg(r) * 252 AS mu FROM t GROUP BY ticker),
  cov AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.r, b.r) * 252 AS cov FROM t a JOIN t b USING (date) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)"""
#: Means m1.. and covariances s11.. of the three tickers in one row.
MOMENTS = f"""{_MU}, o AS (SELECT {", ".join(f"(SELECT mu FROM mu WHERE ticker = '{t}') AS m{k}" for k, t in enumerate(TICKERS, 1))},
  {", ".join(f"(SELECT cov FROM cov WHERE i = '{a}' AND j = '{b}') AS s{m}{n}" for m, a in enumerate(TICKERS, 1) for n, b in enumerate(TICKERS, 1))})"""
_VAR = lambda a, b: " + ".join(f"{a}{m} * {b}{n} * s{m}{n}" for m in (1, 2, 3) for n in (1, 2, 3))
# three weights that sum to 1 and have a given return lie on a line: a point on it, its direction, and the least variance along it
_FRONTIER = f"""WITH {MOMENTS}, k AS (SELECT CAST(k AS INTEGER) AS k, o.*, least(m1, m2, m3) AS lo, greatest(m1, m2, m3) AS hi FROM o, range({TARGETS}) r(k)),
  a AS (SELECT *, lo + (hi - lo) * k / {TARGETS - 1} AS t, k / {TARGETS - 1}::DOUBLE AS th, m2 - m3 AS d1, m3 - m1 AS d2, m1 - m2 AS d3 FROM k),
  b AS (SELECT *, {", ".join(f"CASE WHEN m{i} = hi THEN th ELSE 0 END + CASE WHEN m{i} = lo THEN 1 - th ELSE 0 END AS a{i}" for i in (1, 2, 3))} FROM a),
  c AS (SELECT *, -({_VAR('a', 'd')}) / ({_VAR('d', 'd')}) AS free, greatest({", ".join(f"least(-a{i} / d{i}, (1 - a{i}) / d{i})" for i in (1, 2, 3))}) AS least_s,
        least({", ".join(f"greatest(-a{i} / d{i}, (1 - a{i}) / d{i})" for i in (1, 2, 3))}) AS most_s FROM b),
  e AS (SELECT *, least(greatest(free, least_s), most_s) AS s FROM c), f AS (SELECT *, {", ".join(f"a{i} + s * d{i} AS w{i}" for i in (1, 2, 3))} FROM e), g AS (SELECT *, sqrt({_VAR('w', 'w')}) AS v FROM f)"""
_BOOK = """book AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'EQUITY' WHEN c_mktsegment = 'FURNITURE' THEN 'COMMODITY' ELSE 'OPTION' END AS cls,
  list_extract(['CL', 'NG', 'GC', 'SI', 'HG'], 1 + c_nationkey % 5) AS symbol, c_acctbal AS mv, 0.1::DOUBLE + (k % 7) * 0.05::DOUBLE AS vol, CASE WHEN k % 3 > 0 THEN 0.5::DOUBLE + (k % 5) * 0.25::DOUBLE END AS beta,
  CASE WHEN cls = 'OPTION' THEN (k % 11 - 5) / 10.0::DOUBLE END AS delta, CASE WHEN cls = 'OPTION' THEN (k % 4) / 100.0::DOUBLE END AS gamma, CASE WHEN cls = 'OPTION' THEN (k % 6) / 10.0::DOUBLE END AS vega,
  CASE WHEN cls = 'OPTION' THEN -(k % 3) / 10.0::DOUBLE END AS theta FROM customer)"""
_SIGMA = f"""{_BOOK}, s AS (SELECT cls, vol / sqrt(252) * abs(mv) AS s FROM book), c AS (SELECT cls, sum(s) AS s, sum(s * s) AS ss FROM s GROUP BY cls),
  g AS (SELECT sqrt({P.ACROSS} * pow(sum(s), 2) + ({P.WITHIN} - {P.ACROSS})::DOUBLE * sum(s * s) + (1 - {P.WITHIN})::DOUBLE * sum(ss)) AS sigma, sqrt(sum(ss)) AS independent FROM c)"""
_CHI = " + ".join(f"pow({normal_sql('id', str(g), seed=42)}, 2)" for g in range(1, 6))
_SCENARIOS = ", ".join(f"('{n}', {e}::DOUBLE, {o}::DOUBLE, {g}::DOUBLE, {v}::DOUBLE)" for n, e, o, g, v in P.SCENARIOS)
_LINES = "lines AS (SELECT l_orderkey AS owner, ' s' || (l_partkey % 50) AS symbol, CASE WHEN l_partkey % 7 = 0 THEN 0.0 ELSE l_quantity END AS quantity FROM lineitem)"
_VALID = f"""{_LINES}, v AS (SELECT owner, count(*) AS n, CASE WHEN count(*) > 100 THEN 'too many positions' WHEN count(DISTINCT upper(trim(symbol))) < count(*) THEN 'repeated symbol'
  WHEN count(*) FILTER (quantity IS NULL OR quantity = 0) > 0 THEN 'quantity not finite or zero' ELSE 'ok' END AS reason FROM lines GROUP BY owner)"""

QUERIES = {
    "stats_returns_pivot": returns_pivot, "stats_price_pivot": price_pivot, "stats_correlations_between": correlations_between, "factor_exposures": exposures,
    "portfolio_weight_checks": weight_checks, "portfolio_performance": performance, "portfolio_frontier": frontier, "book_net_greeks": net_greeks, "book_sigma": book_sigma,
    "book_value_at_risk": book_value_at_risk, "book_scenarios": scenario_losses, "book_checked": checked_positions, "book_replaced": replaced_positions,
}

ORACLE_SQL = {
    "stats_returns_pivot": f"WITH {_RET} SELECT date, {sql(**{t: t for t in TICKERS})} FROM x",
    "stats_price_pivot": f"WITH {_WIDE} SELECT date, {sql(**{t: t for t in TICKERS})} FROM p",
    "stats_correlations_between": f"""WITH {WEEKLY}, s AS (SELECT * FROM bars WHERE date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'), t AS (SELECT *, close / lag(close) {OVER} - 1 AS r FROM s)
        SELECT a.ticker AS a, b.ticker AS b, CASE WHEN count(*) >= 2 THEN round(corr(a.r, b.r), 6) END AS corr, count(*) AS n FROM t a JOIN t b USING (date)
        WHERE a.ticker < b.ticker AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""",
    "factor_exposures": f"""WITH {_RET}, c AS (SELECT * FROM x WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL),
        m AS (SELECT count(*) AS n, avg(A) AS ma, avg(N) AS mn, avg(R) AS mr, covar_pop(A, A) AS aa, covar_pop(A, N) AS an, covar_pop(A, R) AS ar, covar_pop(N, N) AS nn, covar_pop(N, R) AS nr, covar_pop(R, R) AS rr FROM c),
        b AS (SELECT *, (an * rr - ar * nr) / (nn * rr - nr * nr) AS b1, (ar * nn - an * nr) / (nn * rr - nr * nr) AS b2 FROM m)
        SELECT f.factor, round(CASE f.factor WHEN 'N' THEN b1 ELSE b2 END, 6) AS beta, round((ma - b1 * mn - b2 * mr) * 252, 6) AS alpha_annual, round((b1 * an + b2 * ar) / aa, 6) AS r2, n
        FROM b, (VALUES ('N'), ('R')) f(factor) WHERE n >= 60""",
    "portfolio_weight_checks": """WITH o AS (SELECT c_mktsegment AS t, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
        w AS (SELECT CASE WHEN t = 'BUILDING' THEN -1 ELSE 1 END * round(v / sum(v) OVER (), 4) AS w FROM o), s AS (SELECT count(*) AS n, count(*) - count(w) AS m, round(sum(w), 6) AS t, count(*) FILTER (w < -0.0001) AS s FROM w)
        SELECT 'count' AS "check", CASE WHEN n = 3 THEN 'PASS' ELSE 'ERROR' END AS status, n::DOUBLE AS value FROM s UNION ALL SELECT 'missing', CASE WHEN m = 0 THEN 'PASS' ELSE 'ERROR' END, m::DOUBLE FROM s
        UNION ALL SELECT 'sum', CASE WHEN abs(t - 1) <= 0.00011 THEN 'PASS' ELSE 'WARN' END, t::DOUBLE FROM s UNION ALL SELECT 'short', CASE WHEN s = 0 THEN 'PASS' ELSE 'WARN' END, s::DOUBLE FROM s""",
    "portfolio_performance": f"""WITH {_MU}, {_W}, v AS (SELECT sqrt(sum(a.w * b.w * cov)) AS v FROM cov JOIN w a ON a.ticker = i JOIN w b ON b.ticker = j),
        g AS (SELECT sum(w * mu) AS r, count(*) AS n, arg_min(ticker, (-w, ticker)) AS la, max(w) AS lw, arg_min(ticker, (w, ticker)) AS sa, min(w) AS sw FROM w JOIN mu USING (ticker))
        SELECT n AS n_assets, la AS largest_asset, sa AS smallest_asset, {sql(expected_return='r', largest_weight='lw', smallest_weight='sw', volatility='v', sharpe='(r - 0.05) / nullif(v, 0)')} FROM g, v""",
    "portfolio_frontier": f"""{_FRONTIER} SELECT k, n.ticker, round(CASE n.ticker WHEN 'A' THEN w1 WHEN 'N' THEN w2 ELSE w3 END, 6) AS w, {sql(target_return='t', volatility='v', sharpe='(w1 * m1 + w2 * m2 + w3 * m3 - 0.05) / v')}
        FROM g, (VALUES ('A'), ('N'), ('R')) n(ticker)""",
    "book_net_greeks": f"WITH {_BOOK} SELECT {sql(**{c: f'coalesce(sum({c}), 0)' for c in ('delta', 'gamma', 'vega', 'theta')})} FROM book WHERE cls = 'OPTION'",
    "book_sigma": f"WITH {_SIGMA} SELECT {sql(sigma='sigma', independent='independent')} FROM g",
    "book_value_at_risk": f"""WITH {_SIGMA}, t AS (SELECT 'HISTORICAL' AS method, 25 AS k, sigma * {normal_sql('id', '0', seed=42)} / sqrt(({_CHI}) / 5) AS pnl FROM range(500) r(id), g
          UNION ALL SELECT 'MONTE_CARLO', 100, independent * {normal_sql('id', '0', seed=43)} FROM range(2000) r(id), g),
        n AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY pnl) - 1 AS rn FROM t)
        SELECT method, round(abs(max(pnl) FILTER (rn = k)), 4) AS var, round(abs(avg(pnl) FILTER (rn < k)), 4) AS es FROM n GROUP BY method
        UNION ALL SELECT 'PARAMETRIC', round(sigma * {S.Z[0.95]}, 4), round(sigma * exp(-0.5 * {S.Z[0.95]} * {S.Z[0.95]}) / (sqrt(2 * pi()) * (1 - 0.95::DOUBLE)), 4) FROM g""",
    "book_scenarios": f"""WITH {_BOOK}, x AS (SELECT book.*, s.*, coalesce(beta, 1.0) AS b, equity * coalesce(beta, 1.0) AS mo, abs(mv) / 100 * 20 AS un FROM book, (VALUES {_SCENARIOS}) s(scenario, equity, oil, gold, vm))
        SELECT c_custkey, scenario, round(CASE cls WHEN 'EQUITY' THEN equity * b * mv WHEN 'COMMODITY' THEN CASE WHEN symbol IN ('CL', 'NG') THEN oil WHEN symbol IN ('GC', 'SI') THEN gold ELSE equity * {P.OTHER_SHARE} END * mv
        ELSE coalesce(delta, 0) * mo * un + 0.5 * coalesce(gamma, 0) * mo * mo * un * un + coalesce(vega, 0) * (vm - 1) * 20 END, 8) AS pnl FROM x""",
    "book_checked": f"WITH {_VALID} SELECT owner, reason = 'ok' AS valid, reason, n FROM v",
    "book_replaced": f"""WITH {_VALID} SELECT owner, sum(quantity * CASE WHEN owner % 2 = 0 AND reason = 'ok' THEN 2 ELSE 1 END) AS quantity, count(*) AS n FROM lines JOIN v USING (owner) GROUP BY owner""",
}
