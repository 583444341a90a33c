"""Queries of option chains, ladders, surfaces and strategies."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_sql
from tidemark.functions.normal import cumulative_sql
from tidemark.operators import derivatives as D
from tidemark.operators import pricing as P
from tidemark.operators import surfaces as V
from tidemark.operators import simulate as M
from tidemark.operators import stats as S
from tidemark.plans.market import _QUOTES, _args, _quotes
from tidemark.plans.models import market_of
from tidemark.plans.sql import LAGGED, OVER, WEEKLY, out
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import table, weekly_bars

DAY = datetime.date(2024, 1, 15)
STEPS = 40
TERMS = {"t": 0.75, "r": 0.05, "q": 0.01}  # of the option that all models price


def checks(spark, d):
    """Inputs derived from parts, some of them wrong."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * F.signum(k % 7)).alias("s"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("k"), ((F.col("p_size") - 3) / 50).alias("t"),
                                          F.when(k % 11 == 0, float("nan")).otherwise(0.2).alias("v"), F.get(F.array(*map(F.lit, ("call", "put", "swap"))), (k % 3).cast("int")).alias("kind"))
    return rows.select("p_partkey", F.coalesce(D.input_error(*map(F.col, ("s", "k", "t", "v", "kind"))), F.lit("ok")).alias("error"))


def summary(spark, d):
    return out(D.validated(_quotes(spark, d)).select("p_partkey", *[c.alias(n) for n, c in D.summary(*_args()).items()]))


def _offers(spark, d):
    """Parts as quotes: symbol by brand, expiry by size, bid and ask around the price, some missing."""
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    rows = table(spark, d, "part").withColumn("spot", F.avg("p_retailprice").over(Window.partitionBy("p_brand")))
    return rows.select(
        "p_partkey", F.col("p_brand").alias("ticker"), "spot", (F.col("p_size") * 5 - 10).alias("days"), (F.round(p / 50) * 50).alias("strike"), (k % 2 == 0).alias("call"),
        F.when(k % 4 > 0, p / 20).alias("bid"), (p / 20 * (1 + (k % 5 - 1) / 50)).alias("ask"), F.when(k % 9 > 0, p / 20 + 1).alias("last"), F.when(k % 6 > 0, 0.1 + (k % 10) / 20).alias("iv"),
        F.when(k % 3 > 0, k).alias("volume"), F.lit(None).cast("long").alias("open_interest"),
    )


def market_prices(spark, d):
    return out(D.market_prices(_offers(spark, d)).select("p_partkey", "market_price", "moneyness"))


def legs(spark, d):
    rows = _offers(spark, d).withColumn("t", F.greatest("days", F.lit(1)) / 365)
    return out(D.legs(rows).select("p_partkey", "delta", "volume", "open_interest"))


def market_chain(spark, d):
    return out(D.market_chain(_offers(spark, d)))


def _spots(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.avg("p_retailprice").alias("spot"))


def synthetic_chain(spark, d):
    return out(D.synthetic_chain(_spots(spark, d)), 4)


def chosen_chain(spark, d):
    """Brands that end on 1 have live rows, the others get synthetic ones: how many of each side, and their mean price."""
    spots = _spots(spark, d)
    live = D.synthetic_chain(spots.filter(F.col("ticker").endswith("1")), n=3).withColumn("market_price", F.col("spot") / 10)
    return out(D.chosen_chain(live, spots).groupBy("ticker", "source", "option_type").agg(F.count(F.lit(1)).alias("n"), F.avg("market_price").alias("mean")), 4)


def sensitivity(spark, d):
    return out(D.sensitivity(_quotes(spark, d)).select("p_partkey", "i", "spot", "price", "delta"))


def models(spark, d):
    """A call 5 percent above the bars' mean close, of their volatility: by formula, by European and American trees, by simulation."""
    start, _, sigma = market_of(spark, d)
    model = {"s": start / 100, "k": round(1.05 * start / 100, 4), "v": sigma, **TERMS}
    one = spark.range(1).select(*[F.lit(v).alias(c) for c, v in model.items()], F.lit(True).alias("call"))
    trees = P.tree_prices(P.tree_prices(one, STEPS).withColumnRenamed("tree", "binomial"), STEPS, american=True).withColumnRenamed("tree", "binomial_american")
    carlo = M.option_price(spark, model["s"], model["k"], model["t"], model["r"], model["v"], model["q"], n=20_000).select(F.col("price").alias("monte_carlo"), "stderr")
    plain = trees.select(P.price(*_args()).alias("formula"), "binomial", "binomial_american")
    return out(plain.join(F.broadcast(carlo)), 4)  # one row with one row


def _last(spark, d):
    bars = weekly_bars(spark, d)
    close = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    # prices of tens of thousands are brought to a size that options have
    return close.join(S.summary(bars).select("ticker", F.col("volatility").alias("sigma")), "ticker").select("ticker", (F.col("close") / 100).alias("spot"), "sigma")


def ladder(spark, d):
    return out(D.ladder(_last(spark, d)))


def greeks_surface(spark, d):
    return out(D.greeks_surface(_last(spark, d)))


def volatility_surface(spark, d):
    return out(D.volatility_surface(table(spark, d, "nation").select(F.col("n_name").alias("ticker"))), 4)


def linear_surface(spark, d):
    rows = _quotes(spark, d).select("t", F.ln(F.col("k") / F.col("s")).alias("m"), F.col("v").alias("iv"))
    return out(D.linear_surface(rows), 5)


def _scattered(spark, d):
    """(ticker, t, m, iv): for each family of brands a quote for each size of its parts; maturity by mean price, moneyness by mean root of
    the key, so that quotes lie on no lines."""
    part = table(spark, d, "part")
    rows = part.groupBy(F.substring("p_brand", 1, 7).alias("ticker"), "p_size").agg(
        (F.avg("p_retailprice") / 1000).alias("t"), (F.avg(F.sqrt(F.col("p_partkey") % 997)) / 32 - 0.65).alias("m")
    )
    return rows.select("ticker", "t", "m", P.smile(F.col("m"), F.col("t")).alias("iv"))


def scattered_surface(spark, d):
    """a grid for each family of brands over quotes that lie on no lines: Delaunay triangles, nearest quotes outside."""
    return out(V.surfaces(_scattered(spark, d)))


def smile(spark, d):
    rows = _quotes(spark, d).select("t", F.ln(F.col("k") / F.col("s")).alias("m"), F.col("v").alias("iv"))
    return out(D.smile_at(P.nearest_surface(rows), 100.0, 0.5))


def strategies(spark, d):
    """The first four parts of each brand as legs."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").withColumns({"rn": F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")), "s": F.avg("p_retailprice").over(Window.partitionBy("p_brand"))}).filter("rn <= 4")
    kind = F.get(F.array(*map(F.lit, ("call", "put", "stock"))), (k % 3).cast("int"))
    legs_ = rows.select(F.col("p_brand").alias("key"), (k % 2 == 1).alias("long"), kind.alias("kind"), F.col("p_retailprice").alias("strike"), (1 + F.col("p_size") % 3).cast("double").alias("qty"), "s",
                        F.lit(0.25).alias("v"), F.lit(0.5).alias("t"), F.lit(0.05).alias("r"), F.lit(0.01).alias("q"))
    return out(D.strategies(legs_).withColumn("breakevens", F.array_join(F.transform("breakevens", lambda x: x.cast("decimal(18,1)").cast("string")), ",")), 4)


def futures(spark, d):
    rows = _spots(spark, d).select(F.col("ticker").alias("symbol"), "spot", (F.ascii(F.substring("ticker", -1, 1)) % 7 / 2 - 1.25).alias("slope"))
    return out(D.futures_curve(rows, F.lit(DAY)))


def _bs(rows: str, name: str = "e") -> str:
    """CTEs that add d1, d2 and what follows from them to rows with s, k, t, r, v, q, g (1 for calls, else -1)."""
    return f"""{name}1 AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM {rows}), {name} AS (SELECT *, d1 - v * sqrt(t) AS d2, g * d1 AS gd1, g * (d1 - v * sqrt(t)) AS gd2,
      exp(-q * t) AS cy, exp(-r * t) AS dr, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f FROM {name}1)"""


_N1, _N2 = cumulative_sql("gd1"), cumulative_sql("gd2")
_PRICE = f"g * (s * cy * {_N1} - k * dr * {_N2})"
_GREEKS = {
    "delta": f"g * cy * {_N1}", "gamma": "cy * f / (s * v * sqrt(t))", "vega": "s * cy * f * sqrt(t)",
    "theta": f"-s * cy * f * v / (2 * sqrt(t)) - g * r * k * dr * {_N2} + g * q * s * cy * {_N1}", "rho": f"g * k * t * dr * {_N2}",
}
_POINTS = {"vega_point": f"({_GREEKS['vega']}) / 100", "theta_day": f"({_GREEKS['theta']}) / 365", "rho_point": f"({_GREEKS['rho']}) / 100"}
_ALL_QUOTES = f"{_QUOTES}, z AS (SELECT *, 0.05::DOUBLE AS r, 0.01::DOUBLE AS q FROM x)"
_OFFERS = """o AS (SELECT p_partkey, p_brand AS ticker, avg(p_retailprice) OVER (PARTITION BY p_brand) AS spot, p_size * 5 - 10 AS days, round(p_retailprice / 50) * 50 AS strike, p_partkey % 2 = 0 AS call,
  CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 20 END AS bid, p_retailprice / 20 * (1 + (p_partkey % 5 - 1) / 50) AS ask, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice / 20 + 1 END AS last,
  CASE WHEN p_partkey % 6 > 0 THEN 0.1::DOUBLE + (p_partkey % 10) / 20 END AS iv, CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS volume FROM part)"""
_SPOTS = "sp AS (SELECT p_brand AS ticker, avg(p_retailprice) AS spot FROM part GROUP BY 1)"
_SMILE = "least(greatest(0.22 - 0.12 * m + 0.4 * m * m + 0.05 * (sqrt(t) - 0.5), 0.05), 1.5)"


def _chain(spots: str, name: str, n: int = 15) -> str:
    """CTEs of a synthetic chain over spots (ticker, spot); the last one is `name`."""
    low = "(spot * (1 - 0.3::DOUBLE))"
    return f"""{name}a AS (SELECT ticker, spot, t, i, {low} + (spot * (1 + 0.3::DOUBLE) - {low}) * i / {n - 1} AS strike FROM {spots}, (VALUES {', '.join(f'({t}::DOUBLE)' for t in D.MATURITIES)}) m(t), range({n}) r(i)),
      {name}b AS (SELECT *, spot AS s, strike AS k, CASE WHEN strike >= spot THEN 1.0::DOUBLE ELSE -1.0 END AS g, ln(strike / spot) AS m, 0.05::DOUBLE AS r, 0.0::DOUBLE AS q FROM {name}a), {name}c AS (SELECT *, {_SMILE}::DOUBLE AS v FROM {name}b),
      {_bs(name + 'c', name + 'e')}, {name} AS (SELECT ticker, spot, t, strike, CASE WHEN g > 0 THEN 'call' ELSE 'put' END AS option_type,
      {_PRICE} * (1 + 0.005::DOUBLE * {normal_sql('ticker', 'CAST(floor(t * 100) AS INTEGER)', 'i', seed=7)}) AS market_price, strike / spot AS moneyness FROM {name}e)"""


def tree_sql(rows: str, steps: int, american: bool, name: str) -> str:
    """A recursive CTE over rows (id, s, k, t, r, v, q, g): the price of a binomial tree, where left = 0, is v[1]. Needs WITH RECURSIVE."""
    hold = "fade * (p * v[j + 2] + (1 - p) * v[j + 1])"
    node = f"greatest({hold}, g * (s * pow(up, 2 * j - (lft - 1)) - k))" if american else hold
    return f"""{name}a AS (SELECT *, t / {steps} AS dt, exp(v * sqrt(t / {steps})) AS up FROM {rows}), {name}b AS (SELECT id, s, k, g, up, exp(-r * dt) AS fade, least(1, greatest(0, (exp((r - q) * dt) - 1 / up) / (up - 1 / up))) AS p FROM {name}a),
      {name} AS (SELECT id, s, k, g, up, fade, p, {steps} AS lft, list_transform(range({steps + 1}), lambda j: greatest(g * (s * pow(up, 2 * j - {steps}) - k), 0.0::DOUBLE)) AS v FROM {name}b
        UNION ALL SELECT id, s, k, g, up, fade, p, lft - 1, list_transform(range(lft), lambda j: {node}) FROM {name} WHERE lft > 0)"""


#: Points (t, m, iv), their hull h and the cells of a grid over it.
SURFACE = f"""{_QUOTES}, pt AS (SELECT t::DOUBLE AS t, m, v AS iv FROM x), h AS (SELECT min(t) AS t0, (max(t) - min(t)) AS dt, min(m) AS m0, (max(m) - min(m)) AS dm FROM pt),
  cell AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, t0 + i * (dt / 24) AS t, m0 + j * (dm / 39) AS m, dt, dm FROM h, range(25) a(i), range(40) b(j)),
  near AS (SELECT i, j, any_value(cell.t) AS t, any_value(cell.m) AS m, arg_min(iv, (pow((cell.t - pt.t) / dt, 2) + pow((cell.m - pt.m) / dm, 2), iv)) AS iv FROM cell, pt GROUP BY i, j)"""
_LINEAR = f"""{SURFACE}, one AS (SELECT t, m, avg(iv) AS iv FROM pt GROUP BY 1, 2), sg AS (SELECT *, lead(m) OVER w AS m2, lead(iv) OVER w AS iv2 FROM one WINDOW w AS (PARTITION BY t ORDER BY m)),
  cj AS (SELECT sg.t, j, avg(iv + (iv2 - iv) * least(1, greatest(0, (m0 + j * (dm / 39) - m) / (m2 - m)))) AS iv FROM sg, h, range(40) r(j) WHERE m2 IS NOT NULL AND j >= (m - m0) / (dm / 39) - 1e-9 AND j <= (m2 - m0) / (dm / 39) + 1e-9 GROUP BY sg.t, j),
  sj AS (SELECT *, lead(t) OVER w AS t2, lead(iv) OVER w AS iv2 FROM cj WINDOW w AS (PARTITION BY j ORDER BY t)),
  li AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, avg(iv + (iv2 - iv) * least(1, greatest(0, (t0 + i * (dt / 24) - t) / (t2 - t)))) AS linear FROM sj, h, range(25) r(i) WHERE t2 IS NOT NULL AND i >= (t - t0) / (dt / 24) - 1e-9 AND i <= (t2 - t0) / (dt / 24) + 1e-9 GROUP BY 1, 2)"""
_LAST = f"""{WEEKLY}, rt AS (SELECT *, close / lag(close) {OVER} - 1 AS r FROM bars), la AS (SELECT ticker, arg_max(close, date) / 100 AS spot, stddev_samp(r) * sqrt(252) AS sigma FROM rt GROUP BY ticker)"""
_OFFSETS, _EXPIRIES = (", ".join(f"({x})" for x in xs) for xs in (D.OFFSETS, D.EXPIRIES))
_HASH = "list_reduce(list_prepend(2166136261::DOUBLE, list_transform(string_split(n_name, ''), lambda c: ascii(c)::DOUBLE)), lambda h, c: fmod(xor(h::BIGINT, c::BIGINT)::DOUBLE * 16777619::DOUBLE, 4294967296::DOUBLE))"
_draw = lambda n: f"(sin(seed + ({n})) * 43758.5453::DOUBLE - floor(sin(seed + ({n})) * 43758.5453::DOUBLE))"
_MODEL = f"""SELECT 1 AS id, s, round(1.05 * s, 4) AS k, v, {', '.join(f'{v}::DOUBLE AS {c}' for c, v in TERMS.items())}, 1.0::DOUBLE AS g FROM
    (SELECT round(avg(close), 2) / 100 AS s, round(stddev_samp(simple_return) * sqrt(52), 4) AS v FROM r)"""
_MC = f"greatest(s * exp((r - q - 0.5 * v * v) * t + v * sqrt(t) * {normal_sql('n', seed=7)}) - k, 0) * exp(-r * t)"

_SMILE = "least(greatest(0.22 - 0.12 * m + 0.4 * m * m + 0.05 * (sqrt(t) - 0.5), 0.05), 1.5)"

QUERIES = {
    "option_checks": checks, "option_summary": summary, "option_market_prices": market_prices, "option_legs": legs, "option_market_chain": market_chain, "option_synthetic_chain": synthetic_chain,
    "option_chosen_chain": chosen_chain, "option_sensitivity": sensitivity, "option_models": models, "option_ladder": ladder, "option_greeks_surface": greeks_surface,
    "option_volatility_surface": volatility_surface, "option_linear_surface": linear_surface, "option_scattered_surface": scattered_surface, "option_smile": smile, "option_strategies": strategies, "futures_curve": futures,
}

ORACLE_SQL = {
    "option_scattered_surface": f"""WITH q AS (SELECT substr(p_brand, 1, 7) AS ticker, p_size AS k, avg(p_retailprice) / 1000 AS t, avg(sqrt(p_partkey % 997)) / 32 - 0.65 AS m
          FROM part GROUP BY 1, 2),
        p AS (SELECT *, {_SMILE} AS iv FROM q),
        three AS (SELECT a.ticker, a.t AS xa, a.m AS ya, a.iv AS va, b.t AS xb, b.m AS yb, b.iv AS vb, c.t AS xc, c.m AS yc, c.iv AS vc,
            (b.t - a.t) * (c.m - a.m) - (b.m - a.m) * (c.t - a.t) AS whole
          FROM p a JOIN p b ON a.ticker = b.ticker AND a.k < b.k JOIN p c ON a.ticker = c.ticker AND b.k < c.k),
        tri AS (SELECT * FROM three WHERE whole <> 0 AND NOT EXISTS (SELECT 1 FROM p d WHERE d.ticker = three.ticker
            AND (d.t, d.m) NOT IN ((xa, ya), (xb, yb), (xc, yc)) AND sign(whole) * (
              ((xa - d.t) ** 2 + (ya - d.m) ** 2) * ((xb - d.t) * (yc - d.m) - (xc - d.t) * (yb - d.m))
              - ((xb - d.t) ** 2 + (yb - d.m) ** 2) * ((xa - d.t) * (yc - d.m) - (xc - d.t) * (ya - d.m))
              + ((xc - d.t) ** 2 + (yc - d.m) ** 2) * ((xa - d.t) * (yb - d.m) - (xb - d.t) * (ya - d.m))) > 0)),
        hull AS (SELECT ticker, min(t) AS t0, max(t) AS t1, min(m) AS m0, max(m) AS m1 FROM p GROUP BY 1),
        cell AS (SELECT ticker, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, t0 + i * (t1 - t0) / 24 AS t, m0 + j * (m1 - m0) / 39 AS m
          FROM hull, range(25) x(i), range(40) y(j)),
        w AS (SELECT cell.*, va, vb, vc, ((cell.t - xa) * (yc - ya) - (cell.m - ya) * (xc - xa)) / whole AS wb,
            ((xb - xa) * (cell.m - ya) - (yb - ya) * (cell.t - xa)) / whole AS wc FROM cell JOIN tri USING (ticker)),
        inside AS (SELECT ticker, i, j, avg(va + wb * (vb - va) + wc * (vc - va)) AS iv FROM w
          WHERE wb >= -1e-12 AND wc >= -1e-12 AND wb + wc <= 1 + 1e-12 GROUP BY 1, 2, 3),
        near AS (SELECT cell.ticker, cell.i, cell.j, arg_min(p.iv, ((p.t - cell.t) ** 2 + (p.m - cell.m) ** 2, p.t, p.m)) AS iv
          FROM cell JOIN p ON p.ticker = cell.ticker GROUP BY 1, 2, 3)
        SELECT ticker, i, j, round(t, 6) AS t, round(m, 6) AS m, round(coalesce(inside.iv, near.iv), 6) AS iv,
          CASE WHEN inside.iv IS NULL THEN 'nearest' ELSE 'linear' END AS source
        FROM cell LEFT JOIN inside USING (ticker, i, j) JOIN near USING (ticker, i, j)""",
    "option_checks": """WITH c AS (SELECT p_partkey, p_retailprice * sign(p_partkey % 7) AS s, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS k, (p_size - 3) / 50 AS t, p_partkey % 11 = 0 AS nv, list_extract(['call', 'put', 'swap'], 1 + p_partkey % 3) AS kind FROM part)
        SELECT p_partkey, CASE WHEN s IS NULL OR s <= 0 THEN 'spot must be positive' WHEN k IS NULL OR k <= 0 THEN 'strike must be positive' WHEN t <= 0 THEN 'maturity must be positive' WHEN nv THEN 'volatility must be positive'
        WHEN kind NOT IN ('call', 'put') THEN 'kind must be call or put' ELSE 'ok' END AS error FROM c""",
    "option_summary": f"WITH {_ALL_QUOTES.replace(', e AS (', ', e0 AS (')}, {_bs('z')} SELECT p_partkey, {sql(price=_PRICE, **_GREEKS, **_POINTS)} FROM e",
    "option_market_prices": f"""WITH {_OFFERS}, m AS (SELECT *, CASE WHEN coalesce(bid, 0) > 0 AND coalesce(ask, 0) > 0 AND coalesce(ask, 0) >= coalesce(bid, 0) THEN 0.5 * (bid + ask) ELSE coalesce(last, 0) END AS p FROM o WHERE strike > 0)
        SELECT p_partkey, round(p, 6) AS market_price, round(strike / spot, 6) AS moneyness FROM m WHERE p > 0""",
    "option_legs": f"""WITH {_OFFERS}, z AS (SELECT *, spot AS s, strike AS k, greatest(days, 1) / 365 AS t, 0.05::DOUBLE AS r, 0.0::DOUBLE AS q, iv AS v, CASE WHEN call THEN 1.0::DOUBLE ELSE -1.0 END AS g FROM o), {_bs('z')}
        SELECT p_partkey, CASE WHEN iv > 0 THEN round({_GREEKS['delta']}, 6) END AS delta, coalesce(volume, 0) AS volume, 0::BIGINT AS open_interest FROM e""",
    "option_market_chain": f"""WITH {_OFFERS}, n AS (SELECT ticker, arg_min(days, (abs(days - 30), days)) AS days FROM o WHERE days > 0 GROUP BY ticker),
        b AS (SELECT ticker, days, strike, max(last) FILTER (call) AS c, max(last) FILTER (NOT call) AS p FROM o JOIN n USING (ticker, days) WHERE strike BETWEEN spot * (1 - 0.3::DOUBLE) AND spot * (1 + 0.3::DOUBLE) GROUP BY 1, 2, 3)
        SELECT ticker, days, round(strike, 6) AS strike, round(c, 6) AS call_last, round(p, 6) AS put_last FROM b WHERE c IS NOT NULL AND p IS NOT NULL""",
    "option_synthetic_chain": f"""WITH {_SPOTS}, {_chain('sp', 'ch')} SELECT ticker, option_type, {", ".join(f"round({c}, 4) AS {c}" for c in ("spot", "t", "strike", "market_price", "moneyness"))} FROM ch WHERE market_price > 0""",
    "option_chosen_chain": f"""WITH {_SPOTS}, lv AS (SELECT * FROM sp WHERE ticker LIKE '%1'), ot AS (SELECT * FROM sp WHERE ticker NOT LIKE '%1'), {_chain('lv', 'ca', 3)}, {_chain('ot', 'cb')},
        u AS (SELECT ticker, 'live' AS source, option_type, spot / 10 AS p FROM ca WHERE market_price > 0 UNION ALL SELECT ticker, 'synthetic', option_type, market_price FROM cb WHERE market_price > 0)
        SELECT ticker, source, option_type, count(*) AS n, round(avg(p), 4) AS mean FROM u GROUP BY 1, 2, 3""",
    "option_sensitivity": f"""WITH {_ALL_QUOTES.replace(', e AS (', ', e0 AS (')}, y AS (SELECT z.* EXCLUDE (s), CAST(i AS INTEGER) AS i, s * 0.6::DOUBLE + (s * 1.4::DOUBLE - s * 0.6::DOUBLE) * i / 59 AS s FROM z, range(60) w(i)), {_bs('y')}
        SELECT p_partkey, i, {sql(spot='s', price=_PRICE, delta=_GREEKS['delta'])} FROM e""",
    "option_models": f"""WITH RECURSIVE {LAGGED}, o AS ({_MODEL}), {_bs('o')}, {tree_sql('o', STEPS, False, 'eu')}, {tree_sql('o', STEPS, True, 'am')}, mc AS (SELECT avg({_MC}) AS m, stddev_samp({_MC}) / sqrt(20000) AS se FROM o, range(20000) w(n))
        SELECT {", ".join(f"round({v}, 4) AS {k}" for k, v in {'formula': _PRICE, 'binomial': '(SELECT v[1] FROM eu WHERE lft = 0)', 'binomial_american': '(SELECT v[1] FROM am WHERE lft = 0)', 'monte_carlo': 'm', 'stderr': 'se'}.items())} FROM e, mc""",
    "option_ladder": f"""WITH {_LAST}, l AS (SELECT *, round(spot * (1 - 0.18::DOUBLE) + (spot * (1 + 0.18::DOUBLE) - spot * (1 - 0.18::DOUBLE)) * i / 12, 2) AS k FROM la, range(13) r(i)), a AS (SELECT *, min((abs(k - spot), k)) OVER (PARTITION BY ticker) AS near FROM l),
        z AS (SELECT ticker, spot AS s, k, days / 365 AS t, sigma AS v, 0.05::DOUBLE AS r, 0.0::DOUBLE AS q, g, days, k = near[2] AS atm FROM a, (VALUES (30), (60), (90), (180)) d(days), (VALUES (1.0::DOUBLE), (-1.0)) c(g)), {_bs('z')}
        SELECT ticker, days, round(k, 6) AS strike, g > 0 AS call, atm AS at_the_money, {sql(price=_PRICE, delta=_GREEKS['delta'], gamma=_GREEKS['gamma'], vega=_POINTS['vega_point'], theta=_POINTS['theta_day'], rho=_POINTS['rho_point'])} FROM e""",
    "option_greeks_surface": f"""WITH {_LAST}, z AS (SELECT ticker, days, offs, spot AS s, spot * (1 + offs / 100) AS k, greatest(1 / 365, days / 365) AS t, sigma AS v, {D.SURFACE_RATE}::DOUBLE AS r, 0.0::DOUBLE AS q, 1.0::DOUBLE AS g
          FROM la, (VALUES {_EXPIRIES}) a(days), (VALUES {_OFFSETS}) b(offs)), {_bs('z')}
        SELECT ticker, days, offs::DOUBLE AS "offset", {sql(delta=_N1, gamma='f / (s * v * sqrt(t))', vega='s * f * sqrt(t) / 100', theta=f'-(s * f * v) / (2 * sqrt(t)) / 365 - r * k * dr * {_N2} / 365', vanna='-(f * d2 / v) / 100',
        charm='-f * (2 * r * t - d2 * v * sqrt(t)) / (2 * t * v * sqrt(t)) / 365')} FROM e""",
    "option_volatility_surface": f"""WITH s AS (SELECT n_name AS ticker, {_HASH} AS seed FROM nation), z AS (SELECT ticker, seed, days, k::DOUBLE AS k FROM s, (VALUES {_EXPIRIES}) a(days), (VALUES {_OFFSETS}) b(k))
        SELECT ticker, days, k AS "offset", round(greatest(6, 22 + {_draw(1)} * 40 + (-0.06::DOUBLE + {_draw(4)} * 0.12::DOUBLE) * (days / 365 - 0.25) + (1 - exp(-days / 30)) * 2 - (0.008::DOUBLE + {_draw(2)} * 0.014::DOUBLE) * k * 100
        + (0.0012::DOUBLE + {_draw(3)} * 0.0018::DOUBLE) * k * k * 100 + ({_draw('days * 31 + k * 7')} - 0.5) * 1.2), 4) AS iv FROM z""",
    "option_linear_surface": f"""WITH {_LINEAR} SELECT near.i, near.j, round(near.t, 5) AS t, round(near.m, 5) AS m, round(coalesce(linear, iv), 5) AS iv, CASE WHEN linear IS NULL THEN 'nearest' ELSE 'linear' END AS source FROM near LEFT JOIN li USING (i, j)""",
    "option_smile": f"""WITH {SURFACE}, w AS (SELECT arg_min(i, (abs(t - 0.5), i)) AS w FROM near) SELECT {sql(strike='100 * exp(m)', m='m', iv='iv', maturity='t')} FROM near, w WHERE i = w""",
    "option_strategies": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, avg(p_retailprice) OVER (PARTITION BY p_brand) AS s FROM part),
        z AS (SELECT p_brand AS key, s, p_retailprice AS k, (CASE WHEN p_partkey % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) * (1 + p_size % 3) AS n, p_partkey % 3 AS kind, 0.5::DOUBLE AS t, 0.05::DOUBLE AS r, 0.25::DOUBLE AS v, 0.01::DOUBLE AS q,
          CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS g FROM l WHERE rn <= 4), {_bs('z')},
        a AS (SELECT key, s, sum(n * CASE WHEN kind = 2 THEN s ELSE {_PRICE} END) AS pr, sum(n * CASE WHEN kind = 2 THEN 1 ELSE {_GREEKS['delta']} END) AS de, sum(CASE WHEN kind = 2 THEN 0 ELSE n * {_GREEKS['gamma']} END) AS ga,
          sum(CASE WHEN kind = 2 THEN 0 ELSE n * {_POINTS['vega_point']} END) AS ve, sum(CASE WHEN kind = 2 THEN 0 ELSE n * {_POINTS['theta_day']} END) AS th, sum(CASE WHEN kind = 2 THEN 0 ELSE n * {_POINTS['rho_point']} END) AS rh FROM e GROUP BY key, s),
        gr AS (SELECT key, i, s * 0.6::DOUBLE + (s * 1.4::DOUBLE - s * 0.6::DOUBLE) * i / 89 AS x, pr FROM a, range(90) w(i)),
        y AS (SELECT gr.key, i, x, round(sum(n * CASE kind WHEN 2 THEN x WHEN 0 THEN greatest(x - k, 0) ELSE greatest(k - x, 0) END) - any_value(pr), 6) AS y FROM gr JOIN z ON z.key = gr.key GROUP BY gr.key, i, x),
        c AS (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM y WINDOW o AS (PARTITION BY key ORDER BY i)),
        b AS (SELECT key, max(y) AS hi, min(y) AS lo, coalesce(string_agg(CASE WHEN (y0 <= 0 AND y > 0) OR (y0 >= 0 AND y < 0) THEN CAST(CAST(round(x0 - y0 * (x - x0) / (y - y0), 2) AS DECIMAL(18, 1)) AS VARCHAR) END, ',' ORDER BY i), '') AS be FROM c GROUP BY key)
        SELECT key, {", ".join(f"round({v}, 4) AS net_{k}" for k, v in {'premium': 'pr', 'delta': 'de', 'gamma': 'ga', 'vega': 've', 'theta': 'th', 'rho': 'rh'}.items())}, round(hi, 4) AS max_profit, round(lo, 4) AS max_loss, be AS breakevens,
        concat_ws('; ', CASE WHEN abs(de) > 0.05 THEN CASE WHEN de > 0 THEN 'short' ELSE 'long' END || ' ' || CAST(abs(round_even(de, 0))::BIGINT AS VARCHAR) || ' shares for a flat delta' END,
        CASE WHEN de > 0.05 THEN 'buy a put out of the money against a fall' WHEN de < -0.05 THEN 'buy a call out of the money against a rise' END, CASE WHEN ve > 0.05 THEN 'sell an option further out against long vega' END, 'sell a wing to pay for the hedge') AS hedges
        FROM a JOIN b USING (key)""",
    "futures_curve": f"""WITH {_SPOTS}, z AS (SELECT ticker AS symbol, spot, (ascii(right(ticker, 1)) % 7 / 2 - 1.25) / 100 AS sl, i FROM sp, range(12) r(i))
        SELECT symbol, CAST(i AS INTEGER) AS month, upper(strftime(DATE '2024-01-01' + to_months(CAST(i + 1 AS INTEGER)), '%b%y')) AS label, round(spot * (1 + sl * (i + 1) + sin(i / 3) * abs(sl) * 0.25), 6) AS price FROM z""",
}
