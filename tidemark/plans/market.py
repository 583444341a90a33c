"""Queries of options, strategies, keyed records and graphs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import cumulative_sql
from tidemark.functions.windows import change, rounded
from tidemark.operators import backtest as B
from tidemark.operators import pricing as P
from tidemark.operators import records as R
from tidemark.plans.sql import BLOCKS, OVER, WEEKLY, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import table, weekly_bars

ENTER, LEAVE = [{"type": "momentum_above", "period": 5, "value": 0.0}, {"type": "rsi_below", "period": 14, "value": 60}], [{"type": "price_below_sma", "period": 20}, {"type": "rsi_above", "period": 14, "value": 70}]
FASTS, SLOWS = [5, 10, 20], [20, 40, 60]


def _out(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _quotes(spark, d):
    """An option on each part: strike its price, spot the mean of its brand, half a year and more by size, volatility by smile."""
    p = table(spark, d, "part")
    spot = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("s"))
    q = p.join(spot, "p_brand").select("p_partkey", "p_brand", "s", F.col("p_retailprice").alias("k"), ((F.col("p_size") + 1) / 50).alias("t"), (F.col("p_partkey") % 2 == 0).alias("call"), F.lit(0.05).alias("r"), F.lit(0.01).alias("q"))
    # parts may lie in few files: rows are dealt to all tasks before they are priced
    return q.repartition("p_partkey").withColumn("v", P.smile(F.ln(F.col("k") / F.col("s")), F.col("t")))


def _args():
    return F.col("s"), F.col("k"), F.col("t"), F.col("r"), F.col("v"), F.col("q"), F.col("call")


def option_prices(spark, d):
    return _out(_quotes(spark, d).select("p_partkey", "v", P.price(*_args()).alias("price")))


def option_greeks(spark, d):
    return _out(_quotes(spark, d).select("p_partkey", *[c.alias(n) for n, c in P.greeks(*_args()).items()]))


def _implied(spark, d):
    q = _quotes(spark, d).withColumn("price", P.price(*_args()))
    s, k, t, r, _, y, call = _args()
    return q.withColumn("iv", P.implied_volatility(F.col("price"), s, k, t, r, y, call))


def option_implied(spark, d):
    """Volatilities found again from prices; those of options whose price hardly moves with them are left out."""
    return _implied(spark, d).filter(P.greeks(*_args())["vega"] > 1).select("p_partkey", F.round("iv", 4).alias("iv"))


def option_tree(spark, d):
    return P.tree_prices(_quotes(spark, d), 100, american=True).select("p_partkey", rounded("tree", 4).alias("tree"))


def option_surface(spark, d):
    return _out(P.nearest_surface(_quotes(spark, d).select("t", F.ln(F.col("k") / F.col("s")).alias("m"), F.col("v").alias("iv"))))


def option_term_structure(spark, d):
    """Volatility of the quote nearest the money at each maturity."""
    q = _quotes(spark, d)
    return _out(q.groupBy("t").agg(F.min_by("v", F.struct(F.round(F.abs(F.ln(F.col("k") / F.col("s"))), 12), "p_partkey")).alias("iv")))


def option_payoff(spark, d):
    """For each brand a long call a twentieth under its mean price and a short one as far above it: payoff over spots of half to one
    and a half times the mean, in percent of it, and where it changes sign."""
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("mean"))
    grid = brands.withColumn("s", F.explode(F.sequence(F.lit(50), F.lit(150)))).withColumn("s", F.col("s") * F.col("mean") / 100)
    mean = F.col("mean")
    legs = F.array(*[F.struct((k * mean).alias("k"), F.lit(n).alias("n"), (c * mean).alias("paid")) for k, n, c in ((0.95, 1.0, 0.08), (1.05, -1.0, 0.035))])
    rows = grid.withColumn("payoff", F.aggregate(legs, F.lit(0.0), lambda a, x: a + x["n"] * (F.greatest(F.col("s") - x["k"], F.lit(0.0)) - x["paid"])))
    w = Window.partitionBy("p_brand").orderBy("s")
    rows = rows.select("p_brand", F.round("s", 6).alias("s"), F.round("payoff", 6).alias("payoff"))
    return rows.withColumn("breakeven", F.coalesce(F.signum("payoff") != F.signum(F.lag("payoff").over(w)), F.lit(False)))


def _strategy(spark, d):
    rows = B.indicators(weekly_bars(spark, d), ENTER + LEAVE)
    n = len(ENTER)
    enter, leave = B.joined([F.col(f"c{i}") for i in range(n)]), B.joined([F.col(f"c{n + i}") for i in range(len(LEAVE))], "any")
    rows = B.positions(rows, enter, leave, **BLOCKS)
    return B.earned(rows, 1, 0.001)


def strategy_run(spark, d):
    return _out(_strategy(spark, d).select("ticker", "date", "position", "strategy_return", "equity"))


def strategy_statistics(spark, d):
    return _out(B.statistics(_strategy(spark, d)))


def strategy_trades(spark, d):
    return _out(B.trades(_strategy(spark, d)))


def strategy_monthly(spark, d):
    return _out(B.monthly(_strategy(spark, d)))


def crossover(spark, d):
    return _out(B.crossover(weekly_bars(spark, d)).select("ticker", "date", "position", "strategy_return", "equity"))


def strategy_grid(spark, d):
    return _out(B.grid(weekly_bars(spark, d), FASTS, SLOWS))


def factor_fill(spark, d):
    """Weekly bars with a score that is set in the first week of each quarter and kept until the next."""
    bars = weekly_bars(spark, d).select("ticker", "date", "close")
    facts = bars.filter((F.month("date") % 3 == 1) & (F.dayofmonth("date") <= 7)).select("ticker", "date", (F.col("close") / 100_000).alias("score"))
    return _out(R.forward_filled(bars, facts, ["ticker"], "date", ["score"]))


def as_of(spark, d):
    """Each purchase with the user's last value of another kind at or before it."""
    e = table(spark, d, "events")
    kinds = F.col("event_type") == "purchase"
    return R.as_of(e.filter(kinds).select("event_id", "user_id", "ts"), e.filter(~kinds).groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", "value").select("event_id", rounded("value").alias("value"))


def latest_runs(spark, d):
    return R.latest(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderdate", "o_orderkey", "o_orderstatus"), "custkey", "o_orderdate", "o_orderkey")


def vintage(spark, d):
    """Daily means of event kinds as known on 2024-01-20, each known from the day after it on."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    e = e.withColumns({"known_from": F.date_add("date", 1), "known_until": F.lit(None).cast("date")})
    return _out(R.known_on(e, F.lit(datetime.date(2024, 1, 20)), "event_type"))


def year_on_year(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return R.year_on_year(o, "o_orderstatus", "month", "total").select("o_orderstatus", "month", rounded("total", 2).alias("total"), rounded("change").alias("change"))


def licences(spark, d):
    """Suppliers as datasets: those of even key are registered, those a customer shares a key with are granted for a while."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    grants = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("dataset"), F.when(F.col("c_acctbal") < 0, "revoked").otherwise("active").alias("status"), F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("c_nationkey")).alias("starts_at"), F.date_add(F.lit(datetime.date(2024, 1, 5)), F.col("c_nationkey") * 2).alias("ends_at"))
    return R.licences(s.select(F.col("s_suppkey").alias("dataset")), s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("dataset")), grants, F.lit(datetime.date(2024, 1, 15)))


def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return R.upsert(c, c.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


def freshness(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    return _out(e.select("user_id", R.freshness(F.col("last"), F.lit(datetime.date(2024, 1, 31)), 30).alias("freshness")))


def _edges(spark, d):
    """Nations by what their suppliers' parts bring in from each customer nation: source, target, share of the source's whole."""
    l, s, o, c = (table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    rows = l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    e = rows.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.sum("l_extendedprice").alias("v")).filter("source <> target")
    return e.select("source", "target", (F.col("v") / F.sum("v").over(Window.partitionBy("source"))).alias("weight"))


def graph_edges(spark, d):
    return _out(_edges(spark, d))


def shock(spark, d):
    """A fall of 10 percent in nation 0 passed on over one and two steps, the second at half strength, summed per nation."""
    e = _edges(spark, d)
    one = e.filter("source = 0").select("target", (-0.1 * F.col("weight")).alias("impact"), F.lit(1).alias("step"))
    two = one.select(F.col("target").alias("source"), F.col("impact").alias("first")).join(e, "source").filter("target <> 0").select("target", (0.5 * F.col("first") * F.col("weight")).alias("impact"), F.lit(2).alias("step"))
    return _out(one.unionByName(two).groupBy("target").agg(F.sum("impact").alias("impact"), F.min("step").alias("step")))


def peers(spark, d):
    """At most six other nations of the same region for each, by name, and the region as benchmark."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    a, b = n.select(F.col("n_nationkey").alias("id"), "n_regionkey"), n.select(F.col("n_nationkey").alias("peer"), "n_name", "n_regionkey")
    pairs = a.join(b, "n_regionkey").filter("id <> peer").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n_name"))).filter("rank <= 6")
    own = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("to"), F.lit("benchmark").alias("relation"))
    return pairs.select("id", F.col("n_name").alias("to"), F.lit("peer").alias("relation")).unionByName(own)


_QUOTES = """q AS (SELECT p_partkey, avg(p_retailprice) OVER (PARTITION BY p_brand) AS s, p_retailprice AS k, (p_size + 1) / 50.0 AS t, p_partkey % 2 = 0 AS call FROM part),
  v AS (SELECT *, ln(k / s) AS m, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS g FROM q), x AS (SELECT *, least(greatest(0.22 - 0.12 * m + 0.4 * m * m + 0.05 * (sqrt(t) - 0.5), 0.05), 1.5) AS v FROM v),
  d AS (SELECT *, (ln(s / k) + (0.05 - 0.01 + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM x), e AS (SELECT *, d1 - v * sqrt(t) AS d2, g * d1 AS gd1, g * (d1 - v * sqrt(t)) AS gd2, exp(-0.01 * t) AS cy, exp(-0.05 * t) AS dr, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f FROM d)"""
_N1, _N2 = cumulative_sql("gd1"), cumulative_sql("gd2")
_UPS = f"CASE WHEN lag(close) {OVER} IS NOT NULL THEN greatest(close - lag(close) {OVER}, 0.0) END AS up, CASE WHEN lag(close) {OVER} IS NOT NULL THEN greatest(lag(close) {OVER} - close, 0.0) END AS down"
_STRATEGY = f"""WITH RECURSIVE {WEEKLY}, g AS (SELECT *, {_UPS}, close / lag(close) {OVER} - 1 AS r, close / lag(close, 5) {OVER} - 1 AS m5, row_number() {OVER} AS i FROM bars),
  s AS (SELECT *, 100 - 100 / (1 + {rolling('avg', 'up', 14)} / nullif({rolling('avg', 'down', 14)}, 0)) AS rsi, {rolling('avg', 'close', 20)} AS m20 FROM g),
  f AS (SELECT *, coalesce(m5 > 0, false) AND coalesce(rsi < 60, false) AS e, coalesce(close < m20, false) OR coalesce(rsi > 70, false) AS x FROM s),
  p AS (SELECT ticker, i, 0 AS position FROM f WHERE i = 1 UNION ALL
        SELECT f.ticker, f.i + 1, CASE WHEN position = 0 AND e THEN 1 WHEN position = 1 AND x THEN 0 ELSE position END FROM p JOIN f ON f.ticker = p.ticker AND f.i = p.i WHERE f.i < (SELECT max(i) FROM f z WHERE z.ticker = f.ticker)),
  h AS (SELECT f.*, position, coalesce(lag(position) OVER (PARTITION BY f.ticker ORDER BY f.i), 0) AS held FROM f JOIN p ON f.ticker = p.ticker AND f.i = p.i),
  t AS (SELECT *, held * coalesce(r, 0) - 0.001 * abs(held - coalesce(lag(held) {OVER}, 0)) AS sr FROM h), eq AS (SELECT *, product(1 + sr) {OVER} AS equity FROM t)"""
_CROSS = lambda a, b: f"""{WEEKLY}, p AS (SELECT *, close / lag(close) {OVER} - 1 AS r, CAST(coalesce({rolling('avg', 'close', a)} > {rolling('avg', 'close', b)}, false) AS INTEGER) AS position FROM bars),
  s AS (SELECT *, coalesce(lag(position) {OVER}, 0) * coalesce(r, 0) AS sr FROM p)"""  # noqa: E731
_GRID = " UNION ALL ".join(f"SELECT ticker, {a} AS fast, {b} AS slow, avg(s) / nullif(stddev_samp(s), 0) * sqrt(252) AS sharpe, product(1 + s) - 1 AS total_return FROM (SELECT ticker, coalesce(lag(p) {OVER}, 0) * coalesce(r, 0) AS s FROM (SELECT ticker, date, r, CAST(coalesce(m{a} > m{b}, false) AS INTEGER) AS p FROM m)) GROUP BY ticker" for a in FASTS for b in SLOWS if a < b)
_EDGES = """v AS (SELECT s_nationkey AS source, c_nationkey AS target, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2), e AS (SELECT source, target, v / sum(v) OVER (PARTITION BY source) AS weight FROM v)"""

QUERIES = {
    "option_prices": option_prices, "option_greeks": option_greeks, "option_implied": option_implied, "option_tree": option_tree, "option_surface": option_surface,
    "option_term_structure": option_term_structure, "option_payoff": option_payoff, "strategy_run": strategy_run, "strategy_statistics": strategy_statistics,
    "strategy_trades": strategy_trades, "strategy_monthly": strategy_monthly, "strategy_crossover": crossover, "strategy_grid": strategy_grid, "join_factor_fill": factor_fill,
    "join_as_of": as_of, "records_latest": latest_runs, "records_vintage": vintage, "records_year_on_year": year_on_year, "records_licences": licences, "records_upsert": upsert,
    "records_freshness": freshness, "graph_edges": graph_edges, "graph_shock": shock, "graph_peers": peers,
}

ORACLE_SQL = {
    "option_prices": f"WITH {_QUOTES} SELECT p_partkey, round(v, 6) AS v, round(g * (s * cy * {_N1} - k * dr * {_N2}), 6) AS price FROM e",
    "option_greeks": f"""WITH {_QUOTES} SELECT p_partkey, {sql(delta=f'g * cy * {_N1}', gamma='cy * f / (s * v * sqrt(t))', vega='s * cy * f * sqrt(t)',
        theta=f'-s * cy * f * v / (2 * sqrt(t)) - g * 0.05 * k * dr * {_N2} + g * 0.01 * s * cy * {_N1}', rho=f'g * k * t * dr * {_N2}')} FROM e""",
    "option_implied": f"WITH {_QUOTES} SELECT p_partkey, round(v, 4) AS iv FROM e WHERE s * cy * f * sqrt(t) > 1",
    "option_term_structure": f"WITH {_QUOTES} SELECT round(t, 6) AS t, round(arg_min(v, (round(abs(m), 12), p_partkey)), 6) AS iv FROM e GROUP BY e.t",
    "option_payoff": """WITH b AS (SELECT p_brand, round(avg(p_retailprice), 2) AS m FROM part GROUP BY 1), g AS (SELECT p_brand, m, i * m / 100 AS s FROM b, range(50, 151) r(i)),
        p AS (SELECT p_brand, round(s, 6) AS s, round(greatest(s - 0.95::DOUBLE * m, 0) - 0.08::DOUBLE * m - greatest(s - 1.05::DOUBLE * m, 0) + 0.035::DOUBLE * m, 6) AS payoff FROM g)
        SELECT p_brand, s, payoff, coalesce(sign(payoff) <> sign(lag(payoff) OVER (PARTITION BY p_brand ORDER BY s)), false) AS breakeven FROM p""",
    "strategy_run": f"{_STRATEGY} SELECT ticker, date, position, round(sr, 6) AS strategy_return, round(equity, 6) AS equity FROM eq",
    "strategy_statistics": f"""{_STRATEGY}, y AS (SELECT *, equity / max(equity) {OVER} - 1 AS dd FROM eq), z AS (SELECT ticker, product(1 + sr) - 1 AS c, count(sr) AS n, avg(sr) AS m, stddev_samp(sr) AS sd, stddev_samp(sr) FILTER (sr < 0) AS dn, min(dd) AS mdd,
        avg(CAST(sr > 0 AS DOUBLE)) FILTER (sr <> 0) AS w, sum(sr) FILTER (sr > 0) / nullif(-sum(sr) FILTER (sr < 0), 0) AS pf, avg(CAST(sr <> 0 AS DOUBLE)) AS ex FROM y GROUP BY ticker)
        SELECT ticker, n, {sql(total_return='c', max_drawdown='mdd', win_rate='w', profit_factor='pf', exposure='ex', cagr='CASE WHEN c > -1 THEN pow(1 + c, 252.0 / n) - 1 END', volatility='sd * sqrt(252)', sharpe='m / nullif(sd, 0) * sqrt(252)', sortino='m / nullif(dn, 0) * sqrt(252)')} FROM z""",
    "strategy_trades": f"""{_STRATEGY}, n AS (SELECT *, CASE WHEN position = 1 AND coalesce(lag(position) {OVER}, 0) = 0 THEN 1 ELSE 0 END AS new, coalesce(lead(date) {OVER}, date) AS nd, coalesce(lead(close) {OVER}, close) AS nc FROM eq),
        k AS (SELECT *, CAST(sum(new) {OVER} AS BIGINT) AS trade FROM n) SELECT ticker, trade, min(date) AS entry, max(nd) AS exit, count(*) AS held, round(arg_max(nc, date) / arg_min(close, date) - 1, 6) AS trade_return FROM k WHERE position = 1 GROUP BY ticker, trade""",
    "strategy_monthly": f"{_STRATEGY} SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, round(product(1 + sr) - 1, 6) AS month_return FROM eq GROUP BY 1, 2",
    "strategy_crossover": f"WITH {_CROSS(10, 40)} SELECT ticker, date, position, round(sr, 6) AS strategy_return, round(product(1 + sr) {OVER}, 6) AS equity FROM s",
    "strategy_grid": f"""WITH {WEEKLY}, m AS (SELECT ticker, date, close / lag(close) {OVER} - 1 AS r, {", ".join(f"{rolling('avg', 'close', n)} AS m{n}" for n in sorted({*FASTS, *SLOWS}))} FROM bars), g AS ({_GRID})
        SELECT ticker, fast, slow, round(sharpe, 6) AS sharpe, round(total_return, 6) AS total_return, row_number() OVER (PARTITION BY ticker ORDER BY round(g.sharpe, 9) DESC NULLS LAST, fast, slow) = 1 AS best FROM g""",
    "join_factor_fill": f"""WITH {WEEKLY}, f AS (SELECT ticker, date, close, CASE WHEN month(date) % 3 = 1 AND day(date) <= 7 THEN close / 100000 END AS s FROM bars)
        SELECT ticker, date, round(close, 6) AS close, round(coalesce(last_value(s IGNORE NULLS) {OVER}, 0), 6) AS score FROM f""",
    "join_as_of": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
        SELECT event_id, round(f.value, 6) AS value FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.ts >= f.ts""",
    "records_latest": "SELECT custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT o_custkey AS custkey, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "records_vintage": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY 1, 2), k AS (SELECT *, lag(value) OVER w AS previous, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS n FROM d WHERE date + 1 <= DATE '2024-01-20' WINDOW w AS (PARTITION BY event_type ORDER BY date))
        SELECT event_type, date, round(value, 6) AS value, round(previous, 6) AS previous, round(value - previous, 6) AS delta FROM k WHERE n = 1""",
    "records_year_on_year": """WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
        SELECT o_orderstatus, month, round(total, 2) AS total, round(total / coalesce(lag(total, 12) OVER w, lag(total) OVER w) - 1, 6) AS change FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""",
    "records_licences": """WITH g AS (SELECT c_custkey AS dataset, CASE WHEN c_acctbal < 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS st, DATE '2024-01-01' + c_nationkey AS a, DATE '2024-01-05' + c_nationkey * 2 AS b FROM customer WHERE c_custkey % 3 <> 0)
        SELECT s_suppkey AS dataset, CASE WHEN s_suppkey % 2 <> 0 THEN 'NOT_REGISTERED' WHEN g.dataset IS NULL THEN 'NOT_GRANTED' WHEN st = 'ACTIVE' AND a > DATE '2024-01-15' THEN 'PENDING' WHEN st = 'ACTIVE' AND b <= DATE '2024-01-15' THEN 'EXPIRED' ELSE st END AS status
        FROM supplier LEFT JOIN g ON g.dataset = s_suppkey""",
    "records_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "records_freshness": "SELECT user_id, round(greatest(0, 1 - date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') / 30.0), 6)::DOUBLE AS freshness FROM events GROUP BY user_id",
    "graph_edges": f"WITH {_EDGES} SELECT source, target, round(weight, 6) AS weight FROM e",
    "graph_shock": f"""WITH {_EDGES}, a AS (SELECT target, -0.1 * weight AS impact, 1 AS step FROM e WHERE source = 0), b AS (SELECT e.target, 0.5 * impact * weight, 2 FROM a JOIN e ON e.source = a.target WHERE e.target <> 0)
        SELECT target, round(sum(impact), 6) AS impact, min(step) AS step FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY target""",
    "graph_peers": """WITH p AS (SELECT a.n_nationkey AS id, b.n_name AS "to", row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_name) AS rn FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
        SELECT id, "to", 'peer' AS relation FROM p WHERE rn <= 6 UNION ALL SELECT n_nationkey, r_name, 'benchmark' FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
