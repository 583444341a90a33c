"""Whitening against whole-matrix numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.whitening import exact_sums, scaled, whiten


def plain(rows, components=16):
    """{(vec_id, component): (n, deviation, whitened, explained)}, by length of vectors."""
    good = [(i, e) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    by = defaultdict(list)
    for i, e in good:
        by[len(e)].append((i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e)))
    out = defaultdict(list)
    for some in by.values():
        distinct = sorted({x for _, x in some})
        n, total = len(distinct), [sum(c) for c in zip(*distinct)]
        centred = np.array([[n * v - s for v, s in zip(x, total)] for x in distinct], float) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        for i, x in some:
            whole = [n * v - s for v, s in zip(x, total)]
            for k in range(min(components, len(values))):
                if values[-1 - k] > 1e-12 * values[-1] and values[-1] > 0:
                    score = abs(np.array(whole, float) / n @ vectors[:, -1 - k]) / math.sqrt(values[-1 - k])
                    out[i, k + 1].append((n, sum(w * w for w in whole), float(score), float(values[-1 - k] / values.sum())))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("dims", [3, 24])
def test_whiten(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(150, dims)) @ rng.normal(size=(dims, dims))
    rows = [(i, [float(np.float32(c)) for c in e]) for i, e in enumerate(base)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (None, rows[3][1])]
    rows += [(600, None), (601, []), (602, [1.0, None, 2.0]), (603, [math.nan] * dims), (604, [math.inf] * dims)]
    rows += [(700 + i, [float(i), float(i % 3)]) for i in range(9)] + [(800, [2.0])]
    docs = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, n int, `x.y` string")
    got, want = whiten(docs.repartition(5)).collect(), plain(rows)
    found = defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append((r.n, int(r.deviation), abs(r.whitened), r.explained))
    assert found.keys() == want.keys() and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for key, rows_ in want.items():
        own = sorted(found[key])
        assert [r[:2] for r in own] == [r[:2] for r in rows_]
        assert np.allclose([r[2:] for r in own], [r[2:] for r in rows_], rtol=1e-7, atol=1e-9)
    assert max(r.component for r in got) == min(dims, 16)
    assert whiten(docs.limit(0)).count() == 0
    # one sign for all rows: signed projections of the distinct rows are uncorrelated with variance 1
    first = {r.vec_id: r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id < 150}
    assert math.isclose(np.var(list(first.values())), 1, rel_tol=1e-9)


def test_large_numbers(spark):
    rows = [(i, [2.0**48 * (i % 3), 2.0**47 * (i % 5), 1.0 * i]) for i in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, total = exact_sums(scaled(docs).select("x"))[3]
    assert n == 40 and list(total) == [sum(math.floor(64 * e[k]) + 1_000_000 for _, e in rows) for k in range(3)]
    got = {(r.vec_id, r.component): r for r in whiten(docs).collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in e] for i, e in rows}
    sums = [sum(v[k] for v in x.values()) for k in range(3)]
    assert all(int(got[i, 1].deviation) == sum((40 * v - s) ** 2 for v, s in zip(x[i], sums)) for i in x)
    with pytest.raises(Exception, match="do not fit"):
        whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).count()
