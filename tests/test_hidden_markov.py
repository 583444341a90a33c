"""Chains against all paths of short series, in blocks of any size; EM never lowers its objective."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.hidden_markov import Chain, best_path, decode, expectation, fit_chain, fit_chains
from tidemark.operators.learn import regimes

DAY = datetime.date(2010, 1, 1)


def chain_of(seed, k, d):
    rng = np.random.default_rng(seed)
    roots = rng.normal(size=(k, d, d))
    return Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.normal(size=(k, d)), roots @ roots.transpose(0, 2, 1) + 0.3 * np.eye(d))


def all_paths(chain, x):
    """Log probability of every path with the rows."""
    log_b, (start, turn) = chain.log_density(x), chain.logs()
    return {p: start[p[0]] + sum(log_b[t, s] for t, s in enumerate(p)) + sum(turn[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(len(start)), repeat=len(x))}


def frame(spark, series):
    rows = [(t, DAY + datetime.timedelta(days=7 * i), *map(float, v)) for t, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "ticker string, date date, a double, b double").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_decoding_equals_all_paths(spark, size):
    chains = {"A": chain_of(1, 3, 2), "B": chain_of(2, 2, 2), "C": chain_of(3, 3, 2)}
    series = {t: np.random.default_rng(i).normal(size=(n, 2)) for i, (t, n) in enumerate((("A", 7), ("B", 8), ("C", 1), ("D", 4)))}
    given = spark.createDataFrame([(t, c.flat()) for t, c in chains.items()], "ticker string, numbers array<double>")
    rows = frame(spark, series).unionByName(spark.createDataFrame([("A", DAY, None, 1.0)], "ticker string, date date, a double, b double"))
    got = decode(rows, ["a", "b"], given, size=size, days=10).orderBy("ticker", "date").collect()
    assert {r.ticker for r in got} == set(chains)
    for t, chain in chains.items():
        paths = all_paths(chain, series[t])
        own = [r for r in got if r.ticker == t]
        assert tuple(r.state for r in own) == max(paths, key=paths.get)
        p = np.exp(np.array(list(paths.values())) - max(paths.values()))
        for i, r in enumerate(own):
            share = [sum(w for w, path in zip(p, paths) if path[i] == s) / p.sum() for s in range(len(chain.start))]
            assert np.allclose(r.probabilities, share) and np.isclose(r.state_probability, max(share))
    assert decode(rows.limit(0), ["a", "b"], given).count() == 0


def test_chain():
    chain = chain_of(5, 3, 2)
    assert all(np.array_equal(a, b) for a, b in zip(vars(Chain.of(chain.flat())).values(), vars(chain).values()))
    x = np.random.default_rng(1).normal(size=(6, 2))
    paths = all_paths(chain, x)
    g, turns, likelihood = expectation(chain.log_density(x), chain)
    total = np.logaddexp.reduce(list(paths.values()))
    assert np.isclose(likelihood, total) and np.allclose(g.sum(1), 1) and np.isclose(turns.sum(), len(x) - 1)
    mean = np.array([chain.means[0]])
    inverse = np.linalg.inv(chain.covariances[0])
    want = -0.5 * ((x - mean) @ inverse * (x - mean)).sum(1) - 0.5 * np.log(np.linalg.det(2 * np.pi * chain.covariances[0]))
    assert np.allclose(chain.log_density(x)[:, 0], want)
    assert best_path(np.zeros((4, 2)), np.zeros(2), np.zeros((2, 2))).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_fitting_never_falls(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.multivariate_normal([0, 0], [[1, 0.9], [0.9, 1]], 90), rng.multivariate_normal([1, -1], [[1, -0.9], [-0.9, 1]], 90)])
    chain, trace = fit_chain(x, 2 + seed % 3, rounds=40, least=-1.0)
    assert len(trace) == 40 and min(np.diff(trace)) > -1e-7
    assert len(fit_chain(x, 2)[1]) < 100
    # covariances are full: the fit sees which way features move together
    assert np.abs(chain.covariances[:, 0, 1]).max() > 0.3
    same, _ = fit_chain(np.zeros((20, 2)), 3)
    assert np.isfinite(same.flat()).all()


def test_models_and_fallback(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(4, 1, (80, 2))])
    rows = frame(spark, {"A": x, "B": x[70:90]})
    got = regimes(rows, ["a", "b"], "hmm", 2)
    models = {r.ticker: r.model for r in got.select("ticker", "model").distinct().collect()}
    assert models == {"A": "hmm", "B": "gmm"} and got.count() == 180
    assert got.filter("ticker = 'A'").groupBy("state").count().count() == 2
    assert {r.model for r in regimes(rows, ["a", "b"], "kmeans", 2).select("model").distinct().collect()} == {"kmeans"}
    assert regimes(rows, ["a", "b"], "gmm", 2).filter(F.col("state_probability") < 0.5).count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        regimes(rows, ["a", "b"], "other")
    fits = fit_chains(rows, ["a", "b"], 2).collect()
    assert {r.ticker for r in fits} == {"A", "B"} and all(0 < r.rounds <= 100 for r in fits)
