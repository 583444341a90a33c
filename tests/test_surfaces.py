"""Delaunay triangulations: empty circles, full cover; planes are met exactly."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.surfaces import _in_circle, _turn, chain_points, delaunay, interpolated, surfaces


def sets():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        yield rng.normal(size=(int(rng.integers(3, 60)), 2))
    yield np.array(list(itertools.product(range(6), range(5))), float)  # all on circles of four
    yield np.array(list(itertools.product(np.linspace(0.1, 0.7, 7), np.linspace(-0.3, 0.3, 7))))
    yield np.array([(0, 0), (1, 0), (2, 0), (3, 0), (1, 1e-9)])
    yield np.array([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (0.5, 0.5)])
    yield np.array([(math.cos(k), math.sin(k)) for k in range(15)])


def area(points, t):
    a, b, c = points[list(t)]
    return ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2


def hull_area(points):
    order = sorted(map(tuple, points.tolist()))
    half = []
    for some in (order, order[::-1]):
        chain = []
        for p in some:
            while len(chain) > 1 and _turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(half, half[1:] + half[:1])) / 2


@pytest.mark.parametrize("points", list(sets()), ids=lambda p: str(len(p)))
def test_triangulation(points):
    triangles = delaunay(points)
    assert all(area(points, t) > 0 for t in triangles)
    assert math.isclose(sum(area(points, t) for t in triangles), hull_area(points), rel_tol=1e-9)
    assert set(triangles.ravel()) == set(range(len(points)))
    for a, b, c in triangles:
        for d in set(range(len(points))) - {a, b, c}:
            assert not _in_circle(*(tuple(points[k].tolist()) for k in (a, b, c, d)))
    # a plane is met exactly everywhere within the hull
    plane = points @ [2.0, -3.0] + 1
    cells = np.random.default_rng(1).dirichlet(np.ones(len(points)), 40) @ points
    got = interpolated(points, plane, triangles, cells)
    assert np.allclose(got, cells @ [2.0, -3.0] + 1)
    assert np.allclose(interpolated(points, plane, triangles, points), plane)
    assert np.isnan(interpolated(points, plane, triangles, points.max(0)[None] + 1)).all()


def test_lines_have_no_triangles():
    assert len(delaunay(np.array([(0, 0), (1, 1), (2, 2), (5, 5)], float))) == 0 and len(delaunay(np.zeros((1, 2)))) == 0


def test_surfaces(spark):
    rng = np.random.default_rng(2)
    rows = [("A", t, m, 0.2 + 0.1 * t - 0.3 * m) for t, m in rng.uniform(size=(40, 2)).tolist()]
    rows += [("B", 1.0, k / 4, 0.1 * k) for k in range(5)] + [("C", 0.5, 0.1, 0.3), ("C", 0.5, 0.1, 0.5)]
    rows += [("A", None, 0.1, 0.2), ("A", 0.1, 0.1, math.nan), ("D", 0.1, 0.2, None), (None, 0.1, 0.1, 0.25)]
    got = surfaces(spark.createDataFrame(rows, "ticker string, t double, m double, iv double"), 7, 9)
    by = {}
    for r in got.collect():
        by.setdefault(r.ticker, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"A": 63, "B": 63, "C": 63, None: 63}
    assert all(math.isclose(r.iv, 0.2 + 0.1 * r.t - 0.3 * r.m) for r in by["A"] if r.source == "linear")
    good = [r for r in rows[:40]]
    for r in by["A"]:
        if r.source == "nearest":
            assert r.iv == min(good, key=lambda p: (p[1] - r.t) ** 2 + (p[2] - r.m) ** 2)[3]
    assert {r.source for r in by["A"]} == {"linear", "nearest"} and {r.source for r in by["B"]} == {"nearest"}
    assert {r.iv for r in by["C"]} == {0.4}
    chain = spark.createDataFrame([("A", 0.5, 100.0, 0.2), ("A", 0.5, 110.0, 5.0), ("A", 0.5, 0.0, 0.3)], "ticker string, t double, strike double, v double")
    assert [tuple(r) for r in chain_points(chain, F.lit(100.0), F.col("v")).collect()] == [("A", 0.5, 0.0, 0.2)]
    assert surfaces(got.limit(0).select("ticker", "t", "m", "iv")).count() == 0
