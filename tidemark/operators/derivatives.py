"""Option chains, ladders, surfaces, strategies and futures curves, all as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_draw
from tidemark.functions.normal import cumulative, density
from tidemark.operators.pricing import greeks, nearest_surface, price, smile

# Strikes in percent of the spot and days to expiry of the generated surfaces; the rate of the greeks'.
OFFSETS = tuple(-25 + 2.5 * i for i in range(21))
EXPIRIES = (7, 14, 30, 45, 60, 90, 120, 180, 270, 365)
SURFACE_RATE = 0.045
# Maturities of a synthetic chain, and expiries of a ladder in days.
MATURITIES = (0.08, 0.25, 0.5, 1.0, 1.5, 2.0)
LADDER_DAYS = (30, 60, 90, 180)
# Basis and factor of the hash of a symbol.
HASH_BASIS, HASH_FACTOR = 2166136261, 16777619


def input_error(s: Column, k: Column, t: Column, v: Column, kind: Column | None = None) -> Column:
    """What is wrong with an option's inputs, or null."""
    bad = lambda c: c.isNull() | F.isnan(c) | (c <= 0)
    out = F.when(bad(s), "spot must be positive").when(bad(k), "strike must be positive").when(bad(t), "maturity must be positive").when(bad(v), "volatility must be positive")
    return out.when(~F.coalesce(kind, F.lit("")).isin("call", "put"), "kind must be call or put") if kind is not None else out


def validated(quotes: DataFrame, kind: str | None = None) -> DataFrame:
    """quotes (s, k, t, v), as they are; a row with a wrong input fails the job."""
    error = input_error(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col(kind) if kind else None)
    return quotes.filter(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))


def summary(s, k, t, r, v, q, call) -> dict[str, Column]:
    """Price and greeks, with vega and rho for a point of volatility and rate, and theta for a day."""
    g = greeks(s, k, t, r, v, q, call)
    return {"price": price(s, k, t, r, v, q, call), **g, "vega_point": g["vega"] / 100, "theta_day": g["theta"] / 365, "rho_point": g["rho"] / 100}


def market_prices(quotes: DataFrame) -> DataFrame:
    """quotes (strike, bid, ask, last, spot) with market_price, the middle where bid and ask stand, else the last, and moneyness;
    rows without a positive finite strike or price are left out."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    middle = (zero("bid") > 0) & (zero("ask") > 0) & (zero("ask") >= zero("bid"))
    strike = F.col("strike")
    rows = quotes.filter(strike.isNotNull() & ~F.isnan(strike) & (strike > 0) & (strike < float("inf")))
    return rows.withColumns({"market_price": F.when(middle, 0.5 * (F.col("bid") + F.col("ask"))).otherwise(zero("last")), "moneyness": strike / F.col("spot")}).filter("market_price > 0")


def synthetic_chain(spots: DataFrame, r: float = 0.05, q: float = 0.0, n: int = 15, band: float = 0.30, seed: int = 7) -> DataFrame:
    """(ticker, spot, t, strike, option_type, market_price, moneyness): options out of the money around each spot, priced with a
    synthetic smile and some noise, which is a hash of the option. spots: ticker, spot."""
    rows = spots.select("ticker", "spot", F.explode(F.array(*map(F.lit, MATURITIES))).alias("t")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    low, high = F.col("spot") * (1 - band), F.col("spot") * (1 + band)
    rows = rows.withColumn("strike", low + (high - low) * F.col("i") / (n - 1))
    call = F.col("strike") >= F.col("spot")
    v = smile(F.ln(F.col("strike") / F.col("spot")), F.col("t"))
    noise = 1 + 0.005 * normal_draw(F.col("ticker"), (F.col("t") * 100).cast("int"), F.col("i"), seed=seed)
    rows = rows.withColumns({"option_type": F.when(call, "call").otherwise("put"), "market_price": price(F.col("spot"), F.col("strike"), F.col("t"), r, v, q, call) * noise, "moneyness": F.col("strike") / F.col("spot")})
    return rows.filter("market_price > 0").select("ticker", "spot", "t", "strike", "option_type", "market_price", "moneyness")


def chosen_chain(live: DataFrame, spots: DataFrame, **how) -> DataFrame:
    """Live rows of the tickers that have some, synthetic ones of the others, with their source."""
    missing = spots.join(live.select("ticker").distinct(), "ticker", "left_anti")
    return live.withColumn("source", F.lit("live")).unionByName(synthetic_chain(missing, **how).withColumn("source", F.lit("synthetic")))


def sensitivity(rows: DataFrame, n: int = 60) -> DataFrame:
    """rows (s, k, t, r, v, q, call) once for each of n spots from 60 to 140 percent: spot, price and delta there."""
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.greatest(F.lit(1e-6), F.col("s") * 0.6), F.col("s") * 1.4
    at = at.withColumn("spot", low + (high - low) * F.col("i") / (n - 1))
    args = (F.col("spot"), F.col("k"), F.col("t"), F.col("r"), F.col("v"), F.col("q"), F.col("call"))
    return at.withColumns({"price": price(*args), "delta": greeks(*args)["delta"]})


def legs(quotes: DataFrame, r: float = 0.05, q: float = 0.0) -> DataFrame:
    """quotes (spot, strike, t, iv, call, volume, open_interest) with delta from the volatility where there is one, counts as whole numbers."""
    delta = greeks(F.col("spot"), F.col("strike"), F.col("t"), F.lit(r), F.col("iv"), F.lit(q), F.col("call"))["delta"]
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return quotes.withColumns({"delta": F.when(F.col("iv") > 0, delta), "volume": whole("volume"), "open_interest": whole("open_interest")})


def market_chain(quotes: DataFrame, target_days: int = 30, band: float = 0.30) -> DataFrame:
    """Per ticker, of quotes (ticker, spot, days, strike, call, last): the expiry nearest to target_days (the first of equals), and its
    strikes within the band that have both a call and a put: days, strike, call_last, put_last. The highest of repeated quotes counts."""
    ahead = quotes.filter("days > 0")
    near = ahead.groupBy("ticker").agg(F.min(F.struct(F.abs(F.col("days") - target_days).alias("off"), F.col("days")))["days"].alias("days"))
    rows = ahead.join(near, ["ticker", "days"]).filter(F.col("strike").between(F.col("spot") * (1 - band), F.col("spot") * (1 + band)))
    both = rows.groupBy("ticker", "days", "strike").agg(F.max(F.when(F.col("call"), F.col("last"))).alias("call_last"), F.max(F.when(~F.col("call"), F.col("last"))).alias("put_last"))
    return both.filter("call_last is not null and put_last is not null")


def ladder(spots: DataFrame, r: float = 0.05, q: float = 0.0, n: int = 13, band: float = 0.18) -> DataFrame:
    """Theoretical calls and puts of each (ticker, spot, sigma): four expiries, n strikes; at_the_money marks the strike nearest to the spot."""
    low, high = F.col("spot") * (1 - band), F.col("spot") * (1 + band)
    strikes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + (high - low) * i / (n - 1), 2))
    rows = spots.withColumn("strikes", strikes)
    nearest = F.array_min(F.transform("strikes", lambda k: F.struct(F.abs(k - F.col("spot")).alias("off"), k.alias("k"))))["k"]
    rows = rows.withColumn("atm", nearest).select("*", F.explode("strikes").alias("strike")).select("*", F.explode(F.array(*map(F.lit, LADDER_DAYS))).alias("days")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("call"))
    s = summary(F.col("spot"), F.col("strike"), F.col("days") / 365, F.lit(r), F.col("sigma"), F.lit(q), F.col("call"))
    named = {"price": s["price"], "delta": s["delta"], "gamma": s["gamma"], "vega": s["vega_point"], "theta": s["theta_day"], "rho": s["rho_point"]}
    return rows.select("ticker", "days", "strike", "call", (F.col("strike") == F.col("atm")).alias("at_the_money"), *[c.alias(k) for k, c in named.items()])


def strategies(legs_: DataFrame, points: int = 90) -> DataFrame:
    """Per key, of legs (key, long, kind, strike, qty, s, v, t, r, q): net premium and greeks, highest and lowest payoff over spots from
    60 to 140 percent, where the payoff changes sign, and hedges. kind: call, put or stock."""
    sign = F.when(F.col("long"), 1.0).otherwise(-1.0) * F.col("qty")
    stock = F.col("kind") == "stock"
    g = summary(F.col("s"), F.col("strike"), F.col("t"), F.col("r"), F.col("v"), F.col("q"), F.col("kind") == "call")
    parts = {"premium": F.when(stock, F.col("s")).otherwise(g["price"]), "delta": F.when(stock, 1.0).otherwise(g["delta"])}
    parts |= {n: F.when(stock, 0.0).otherwise(g[c]) for n, c in (("gamma", "gamma"), ("vega", "vega_point"), ("theta", "theta_day"), ("rho", "rho_point"))}
    leg = F.struct("kind", "strike", sign.alias("n"))
    # a strategy has a few legs
    net = legs_.groupBy("key", "s").agg(*[F.sum(sign * c).alias(f"net_{n}") for n, c in parts.items()], F.collect_list(leg).alias("legs"))
    low, high = F.greatest(F.lit(1e-6), F.col("s") * 0.6), F.col("s") * 1.4
    spots = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + (high - low) * i / (points - 1))
    worth = lambda x: F.aggregate("legs", F.lit(0.0), lambda a, e: a + e["n"] * F.when(e["kind"] == "stock", x).when(e["kind"] == "call", F.greatest(x - e["strike"], F.lit(0.0))).otherwise(F.greatest(e["strike"] - x, F.lit(0.0))))
    net = net.withColumn("grid", spots).withColumn("payoff", F.transform("grid", lambda x: F.round(worth(x) - F.col("net_premium"), 6)))
    y = lambda i: F.get("payoff", i)
    x = lambda i: F.get("grid", i)
    crossing = F.filter(F.sequence(F.lit(1), F.lit(points - 1)), lambda i: ((y(i - 1) <= 0) & (y(i) > 0)) | ((y(i - 1) >= 0) & (y(i) < 0)))
    breakevens = F.transform(crossing, lambda i: F.round(x(i - 1) - y(i - 1) * (x(i) - x(i - 1)) / (y(i) - y(i - 1)), 2))
    nd = F.col("net_delta")
    shares = F.abs(F.bround(nd)).cast("long").cast("string")
    hedges = F.concat_ws(
        "; ",
        F.when(F.abs(nd) > 0.05, F.concat(F.when(nd > 0, "short").otherwise("long"), F.lit(" "), shares, F.lit(" shares for a flat delta"))),
        F.when(nd > 0.05, "buy a put out of the money against a fall").when(nd < -0.05, "buy a call out of the money against a rise"),
        F.when(F.col("net_vega") > 0.05, "sell an option further out against long vega"),
        F.lit("sell a wing to pay for the hedge"),
    )
    return net.select("key", *[f"net_{n}" for n in parts], F.array_max("payoff").alias("max_profit"), F.array_min("payoff").alias("max_loss"), breakevens.alias("breakevens"), hedges.alias("hedges"))


def futures_curve(spots: DataFrame, day: Column, months: int = 12) -> DataFrame:
    """(symbol, month, label, price) of the months after a day, of (symbol, spot, slope in percent a month)."""
    rows = spots.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    slope, i = F.col("slope") / 100, F.col("month")
    value = F.col("spot") * (1 + slope * (i + 1) + F.sin(i / 3) * F.abs(slope) * 0.25)
    label = F.upper(F.date_format(F.add_months(F.trunc(day, "month"), i + 1), "MMMyy"))
    return rows.select("symbol", "month", label.alias("label"), value.alias("price"))


def _grid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("days", F.explode(F.array(*map(F.lit, EXPIRIES)))).withColumn("offset", F.explode(F.array(*map(F.lit, OFFSETS))))


def greeks_surface(spots: DataFrame) -> DataFrame:
    """(ticker, days, offset, delta, gamma, vega, theta, vanna, charm) of calls over a grid of expiries and strikes; spots: ticker, spot, sigma."""
    rows = _grid(spots)
    s, v, r = F.col("spot"), F.col("sigma"), SURFACE_RATE
    t, k = F.greatest(F.lit(1 / 365), F.col("days") / 365), s * (1 + F.col("offset") / 100)
    rows = rows.withColumns({"_t": t, "_k": k})
    t, k, root = F.col("_t"), F.col("_k"), v * F.sqrt("_t")
    d1 = (F.ln(s / k) + (r + 0.5 * v * v) * t) / root
    rows = rows.withColumn("_d1", d1)
    d1, d2, f = F.col("_d1"), F.col("_d1") - root, density(F.col("_d1"))
    return rows.select(
        "ticker", "days", "offset", cumulative(d1).alias("delta"), (f / (s * root)).alias("gamma"), (s * f * F.sqrt(t) / 100).alias("vega"),
        (-(s * f * v) / (2 * F.sqrt(t)) / 365 - r * k * F.exp(-r * t) * cumulative(d2) / 365).alias("theta"), (-(f * d2 / v) / 100).alias("vanna"),
        (-f * (2 * r * t - d2 * root) / (2 * t * root) / 365).alias("charm"),
    )


def volatility_surface(symbols: DataFrame) -> DataFrame:
    """(ticker, days, offset, iv in percent): a plausible surface that depends on the ticker's name alone."""
    characters = F.split("ticker", "")
    # products pass 2**53: they are taken in doubles, and so is the rest by 2**32
    seed = F.aggregate(F.filter(characters, lambda c: c != ""), F.lit(float(HASH_BASIS)), lambda h, c: F.pmod(h.cast("long").bitwiseXOR(F.ascii(c).cast("long")).cast("double") * float(HASH_FACTOR), F.lit(float(1 << 32))))
    rows = _grid(symbols.select("ticker", seed.alias("seed")))

    def draw(n) -> Column:
        x = F.sin(F.col("seed") + n) * 43758.5453
        return x - F.floor(x)

    days, k = F.col("days"), F.col("offset")
    term = (-0.06 + draw(4) * 0.12) * (days / 365 - 0.25) + (1 - F.exp(-days / 30)) * 2
    value = 22 + draw(1) * 40 + term - (0.008 + draw(2) * 0.014) * k * 100 + (0.0012 + draw(3) * 0.0018) * k * k * 100 + (draw(days * 31 + k * 7) - 0.5) * 1.2
    return rows.select("ticker", "days", "offset", F.greatest(F.lit(6.0), value).alias("iv"))


def linear_surface(points: DataFrame, n_t: int = 25, n_m: int = 40) -> DataFrame:
    """A regular grid over the points (t, m, iv): linear in m between neighbours of one maturity, then linear in t between maturities;
    cells that lie outside take the nearest point. (i, j, t, m, iv, source.)

    Each pair of neighbours makes the grid columns between them, so no point meets a cell that it does not touch.
    """
    hull = points.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("m").alias("m0"), F.max("m").alias("m1")).first()
    cells = nearest_surface(points, n_t, n_m)
    if hull.t0 is None:
        return cells.withColumn("source", F.lit("nearest"))

    def between(rows: DataFrame, by: str, x: str, start: float, step: float, n: int, name: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(x)
        pairs = rows.withColumns({"x2": F.lead(x).over(w), "iv2": F.lead("iv").over(w)}).filter("x2 is not null")
        first, last = F.ceil((F.col(x) - start) / step - 1e-9).cast("int"), F.floor((F.col("x2") - start) / step + 1e-9).cast("int")
        each = pairs.withColumns({"a": F.greatest(first, F.lit(0)), "b": F.least(last, F.lit(n - 1))}).filter("a <= b").withColumn(name, F.explode(F.sequence("a", "b")))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (start + F.col(name) * step - F.col(x)) / (F.col("x2") - F.col(x))))
        return each.groupBy(by, name).agg(F.avg(F.col("iv") + (F.col("iv2") - F.col("iv")) * share).alias("iv"))

    dt, dm = ((hull.t1 - hull.t0) or 1e-6) / max(1, n_t - 1), ((hull.m1 - hull.m0) or 1e-6) / max(1, n_m - 1)
    one = points.groupBy("t", "m").agg(F.avg("iv").alias("iv"))
    columns = between(one, "t", "m", hull.m0, dm, n_m, "j")
    found = between(columns, "j", "t", hull.t0, dt, n_t, "i").withColumnRenamed("iv", "linear")
    both = cells.join(found, ["i", "j"], "left")
    return both.select("i", "j", "t", "m", F.coalesce("linear", "iv").alias("iv"), F.when(F.col("linear").isNull(), "nearest").otherwise("linear").alias("source"))


def smile_at(surface: DataFrame, spot: float, maturity: float) -> DataFrame:
    """(strike, m, iv, maturity) of the grid row nearest to a maturity, the first of equals."""
    row = surface.agg(F.min(F.struct(F.abs(F.col("t") - maturity).alias("off"), F.col("i")))["i"].alias("_i"))  # one row
    rows = surface.join(F.broadcast(row), F.col("i") == F.col("_i"))
    return rows.select((spot * F.exp("m")).alias("strike"), "m", "iv", F.col("t").alias("maturity"))
