"""Option prices, greeks and implied volatility in columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normal import cumulative, cumulative_of, density

TREE_ROWS = 1000  # trees that are priced together


def _d1(s, k, t, r, v, q) -> Column:
    return (F.ln(s / k) + (r - q + v * v / 2) * t) / (v * F.sqrt(t))


def price(s: Column, k: Column, t: Column, r, v: Column, q, call: Column) -> Column:
    """Black-Scholes-Merton price with a dividend yield; call: true or false."""
    d1 = _d1(s, k, t, r, v, q)
    d2 = d1 - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * (s * F.exp(-q * t) * cumulative(sign * d1) - k * F.exp(-r * t) * cumulative(sign * d2))


def greeks(s: Column, k: Column, t: Column, r, v: Column, q, call: Column) -> dict[str, Column]:
    """delta, gamma, vega, theta (a year) and rho."""
    d1 = _d1(s, k, t, r, v, q)
    d2 = d1 - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    carry, rate = F.exp(-q * t), F.exp(-r * t)
    return {
        "delta": sign * carry * cumulative(sign * d1),
        "gamma": carry * density(d1) / (s * v * F.sqrt(t)),
        "vega": s * carry * density(d1) * F.sqrt(t),
        "theta": -s * carry * density(d1) * v / (2 * F.sqrt(t)) - sign * r * k * rate * cumulative(sign * d2) + sign * q * s * carry * cumulative(sign * d1),
        "rho": sign * k * t * rate * cumulative(sign * d2),
    }


def implied_volatility(target: Column, s: Column, k: Column, t: Column, r, q, call: Column, low: float = 1e-4, high: float = 5.0, steps: int = 50) -> Column:
    """The volatility at which the price meets the target, by halving [low, high]; null where the target lies outside. All rows of an
    Arrow batch are halved together."""

    @F.pandas_udf("double")
    def halved(target, s, k, t, r, q, sign):
        import pandas as pd

        target, s, k, t, r, q, sign = (x.to_numpy(float) for x in (target, s, k, t, r, q, sign))
        m, root = np.log(s / k), np.sqrt(t)
        spot, strike, drift = s * np.exp(-q * t), k * np.exp(-r * t), r - q

        def at(v):
            d1 = (m + (drift + v * v / 2) * t) / (v * root)
            return sign * (spot * cumulative_of(sign * d1) - strike * cumulative_of(sign * (d1 - v * root)))

        with np.errstate(all="ignore"):
            a, b = np.full(len(s), low), np.full(len(s), high)
            inside = (at(a) <= target) & (at(b) >= target)
            for _ in range(steps):
                middle = (a + b) / 2
                below = at(middle) < target
                a, b = np.where(below, middle, a), np.where(below, b, middle)
        return pd.Series(np.where(inside, (a + b) / 2, np.nan))

    number = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    return halved(*map(number, (target, s, k, t, r, q)), F.when(call, 1.0).otherwise(-1.0))


def tree_prices(quotes: DataFrame, steps: int = 200, american: bool = False) -> DataFrame:
    """quotes (s, k, t, r, v, q, call) with `tree`: the price on a binomial lattice of `steps` steps, at least 2."""
    steps = max(2, steps)

    j = np.arange(steps + 1)

    @F.pandas_udf("double")
    def tree(s, k, t, r, v, q, call):
        import pandas as pd

        out = []
        for a in range(0, len(s), TREE_ROWS):
            # rows by nodes: all trees of a slice go back one step at a time together
            s0, k0, t0, r0, v0, q0 = (x.to_numpy(float)[a : a + TREE_ROWS, None] for x in (s, k, t, r, v, q))
            side = np.where(call.to_numpy(bool)[a : a + TREE_ROWS, None], 1.0, -1.0)
            dt = t0 / steps
            up = np.exp(v0 * np.sqrt(dt))
            p = np.clip((np.exp((r0 - q0) * dt) - 1 / up) / (up - 1 / up), 0, 1)
            fade = np.exp(-r0 * dt)
            spot = s0 * up ** (2.0 * j - steps)
            value = np.maximum(side * (spot - k0), 0)
            for _ in range(steps):
                spot = spot[:, 1:] / up
                value = fade * (p * value[:, 1:] + (1 - p) * value[:, :-1])
                if american:
                    value = np.maximum(value, side * (spot - k0))
            out.append(value[:, 0])
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return quotes.withColumn("tree", tree("s", "k", "t", "r", "v", "q", "call"))


def smile(log_moneyness: Column, t: Column, base=0.22, skew=-0.12, curve=0.4, term=0.05) -> Column:
    """A synthetic volatility by moneyness and maturity, kept within 5 and 150 percent."""
    return F.least(F.greatest(base + skew * log_moneyness + curve * log_moneyness * log_moneyness + term * (F.sqrt(t) - 0.5), F.lit(0.05)), F.lit(1.5))


def nearest_surface(points: DataFrame, n_t: int = 25, n_m: int = 40) -> DataFrame:
    """A regular grid over the points (t, m, iv), each cell with the volatility of the nearest point, distances scaled to the hull.

    The grid has n_t * n_m cells; each task keeps for its points the nearest one of every cell, and these meet in a minimum.
    """
    hull = points.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("m").alias("m0"), F.max("m").alias("m1")).first()
    if hull.t0 is None:
        return points.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "t", "m", "iv").limit(0)
    ts, ms = np.linspace(hull.t0, hull.t1, n_t), np.linspace(hull.m0, hull.m1, n_m)
    dt, dm = (hull.t1 - hull.t0) or 1.0, (hull.m1 - hull.m0) or 1.0

    def nearest(batches):
        best, value = np.full((n_t, n_m), np.inf), np.full((n_t, n_m), np.nan)
        for b in batches:
            for t, m, iv in zip(*(c.to_pylist() for c in b.columns)):
                d = ((ts[:, None] - t) / dt) ** 2 + ((ms[None, :] - m) / dm) ** 2
                closer = (d < best) | ((d == best) & (iv < value))
                best[closer], value[closer] = d[closer], iv
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "d": best[i, j], "iv": value[i, j]})

    cells = points.select(*[F.col(c).cast("double") for c in ("t", "m", "iv")]).dropna().mapInArrow(nearest, "i int, j int, d double, iv double")
    out = cells.groupBy("i", "j").agg(F.min(F.struct("d", "iv"))["iv"].alias("iv"))
    place = lambda c, a, b, n: a + F.col(c) * ((b - a) / max(1, n - 1))
    return out.select("i", "j", place("i", float(ts[0]), float(ts[-1]), n_t).alias("t"), place("j", float(ms[0]), float(ms[-1]), n_m).alias("m"), "iv")
