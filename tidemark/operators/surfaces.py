"""Volatility surfaces over scattered quotes: Delaunay triangulation, and linear interpolation within its triangles.

A ticker's chain is one group; its quotes are triangulated and its grid is filled there. Signs of areas and circles are
exact: where rounding could turn one over, it is taken again in fractions.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURFACE = "i int, j int, t double, m double, iv double, source string"
ROUNDING = 1e-12  # of the terms of a determinant


def _turn(a, b, c) -> int:
    """1 if a, b, c turn left, -1 if right, 0 on a line."""
    one, two = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(one - two) <= ROUNDING * (abs(one) + abs(two)):
        (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
        one, two = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    return (one > two) - (one < two)


def _in_circle(a, b, c, d) -> bool:
    """Whether d lies within the circle through a, b, c, which turn left; not if on it."""

    def determinant(points):
        rows = [(x - d_[0], y - d_[1]) for x, y in points[:3] for d_ in points[3:]]
        squares = [x * x + y * y for x, y in rows]
        terms = []
        for k in range(3):
            (x1, y1), (x2, y2) = rows[(k + 1) % 3], rows[(k + 2) % 3]
            terms += [squares[k] * x1 * y2, -squares[k] * y1 * x2]
        return sum(terms), sum(map(abs, terms))

    value, size = determinant([a, b, c, d])
    if abs(value) <= ROUNDING * size:
        value, _ = determinant([tuple(map(Fraction, p)) for p in (a, b, c, d)])
    return value > 0


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (three numbers of points, turning left) of different points, whose circles hold no other point. None where all lie on a line.

    A sweep from left to right joins each point with the edges of the hull that it sees; then edges whose circle holds the
    point across are turned over until there are none.
    """
    order = sorted(range(len(points)), key=lambda k: tuple(points[k]))
    at = [tuple(map(float, p)) for p in points]
    apex = next((k for k in range(2, len(order)) if _turn(at[order[0]], at[order[1]], at[order[k]])), None)
    if apex is None:
        return np.empty((0, 3), int)
    line, p = order[:apex], order[apex]
    left = _turn(at[line[0]], at[line[1]], at[p]) > 0
    # the triangle to the left of each directed edge is named by the point across
    across: dict[tuple[int, int], int] = {}

    def put(a: int, b: int, c: int) -> None:
        across[a, b], across[b, c], across[c, a] = c, a, b

    for a, b in zip(line, line[1:]):
        put(*((a, b, p) if left else (b, a, p)))
    hull = [*line, p] if left else [*line[::-1], p]
    for p in order[apex + 1 :]:
        seen = [k for k in range(len(hull)) if _turn(at[hull[k]], at[hull[(k + 1) % len(hull)]], at[p]) < 0]
        for k in seen:
            put(hull[(k + 1) % len(hull)], hull[k], p)
        inner = {hull[k] for k in seen} & {hull[(k + 1) % len(hull)] for k in seen}
        first = next(k for k in seen if hull[k] not in inner)
        hull = hull[first:] + hull[:first]
        hull = [hull[0], p] + [h for h in hull[1:] if h not in inner]
    open_ = [(a, b) for a, b in across if a < b]
    while open_:
        a, b = open_.pop()
        c, d = across.get((a, b)), across.get((b, a))
        if c is None or d is None or not _in_circle(at[a], at[b], at[c], at[d]):
            continue
        del across[a, b], across[b, a]
        put(c, d, b)
        put(d, c, a)
        open_ += [(a, d), (d, b), (b, c), (c, a)]
    return np.array(sorted({min((a, b, c), (b, c, a), (c, a, b)) for (a, b), c in across.items()}), int)


def interpolated(points: np.ndarray, values: np.ndarray, triangles: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Values at cells by barycentric weights in the triangle that holds each; NaN outside all. Of triangles that share an edge
    the larger one says what holds on it, as weights in a sliver are all rounding."""
    out = np.full(len(cells), np.nan)
    sides = points[triangles[:, 1:]] - points[triangles[:, :1]] if len(triangles) else np.empty((0, 2, 2))
    for a, b, c in triangles[np.argsort(-np.linalg.det(sides), kind="stable")]:
        (ax, ay), (bx, by), (cx, cy) = points[a], points[b], points[c]
        near = (cells >= np.min(points[[a, b, c]], 0)).all(1) & (cells <= np.max(points[[a, b, c]], 0)).all(1) & np.isnan(out)
        x, y = cells[near].T
        whole = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        wb = ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / whole
        wc = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / whole
        inside = (wb >= -1e-12) & (wc >= -1e-12) & (wb + wc <= 1 + 1e-12)
        out[np.flatnonzero(near)[inside]] = (values[a] + wb * (values[b] - values[a]) + wc * (values[c] - values[a]))[inside]
    return out


def surfaces(points: DataFrame, n_t: int = 25, n_m: int = 40) -> DataFrame:
    """(ticker, SURFACE): for each ticker a regular grid over its points (ticker, t, m, iv): linear in the Delaunay triangle that holds a
    cell; outside all triangles the nearest point's value, of equally near ones that of the least t, then m.

    Points with a missing or non-finite number are left out; of points at one place the mean counts. Tickers whose points all
    lie on a line have nearest values throughout; a range without width is widened by a millionth. A chain is one group.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in ("t", "m", "iv")]
    finite = points.select("ticker", *numbers).filter(" and ".join(f"{c} - {c} = 0" for c in ("t", "m", "iv")))
    one = finite.groupBy("ticker", "t", "m").agg(F.avg("iv").alias("iv"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "m"], ignore_index=True)
        xy, iv = pdf[["t", "m"]].to_numpy(float), pdf["iv"].to_numpy(float)
        low, high = xy.min(0), xy.max(0)
        high = np.where(high > low, high, low + 1e-6)
        ts, ms = np.linspace(low[0], high[0], n_t), np.linspace(low[1], high[1], n_m)
        cells = np.stack(np.meshgrid(ts, ms, indexing="ij"), -1).reshape(-1, 2)
        linear = interpolated(xy, iv, delaunay(xy), cells)
        outside = np.isnan(linear)
        nearest = ((cells[outside][:, None] - xy[None]) ** 2).sum(2).argmin(1)
        linear[outside] = iv[nearest]
        i, j = np.divmod(np.arange(len(cells)), n_m)
        source = np.where(outside, "nearest", "linear")
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "i": i, "j": j, "t": cells[:, 0], "m": cells[:, 1], "iv": linear, "source": source})

    kind = one.schema["ticker"].dataType.simpleString()
    return one.groupBy("ticker").applyInPandas(fill, f"ticker {kind}, {SURFACE}")


def chain_points(chain: DataFrame, spot: Column, iv: Column, *, floor: float = 0.01, cap: float = 3.0) -> DataFrame:
    """(ticker, t, m, iv) of the quotes of a chain whose volatility was found and lies within bounds; m: log of strike over spot."""
    rows = chain.withColumns({"_iv": iv, "_m": F.when((F.col("strike") > 0) & (spot > 0), F.ln(F.col("strike") / spot))})
    return rows.filter(F.col("_iv").between(floor, cap)).select("ticker", "t", F.col("_m").alias("m"), F.col("_iv").alias("iv")).dropna()
