"""Portfolios, regimes, derivatives, graphs, evidence and filings on small literal frames, and against brute force."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, derivatives, evidence, filings, graphs, learn, optimize, portfolio, pricing, regimes
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def _random_moments(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 2))
    return rng.normal(0.08, 0.05, n), a @ a.T / 50


@pytest.mark.parametrize("seed,n,most", [(0, 3, 1.0), (1, 4, 1.0), (2, 5, 0.4), (3, 2, 1.0)])
def test_frontier_beats_random_weights(seed, n, most):
    mu, sigma = _random_moments(seed, n)
    rng = np.random.default_rng(seed)
    tries = rng.dirichlet(np.ones(n), 40_000)
    tries = tries[tries.max(axis=1) <= most]
    returns, risks = tries @ mu, np.einsum("ij,jk,ik->i", tries, sigma, tries)
    for target, risk in zip(returns[:200], risks[:200]):
        w = optimize.frontier_weights(mu, sigma, float(target), most)
        assert w.sum() == pytest.approx(1) and w @ mu == pytest.approx(target) and w.min() >= -1e-12 and w.max() <= most + 1e-9
        assert w @ sigma @ w <= risk + 1e-12
    w = optimize.minimum_variance(sigma, most)
    assert w @ sigma @ w <= risks.min() + 1e-9
    w = optimize.maximum_sharpe(mu, sigma, 0.02, most)
    assert (w @ mu - 0.02) / math.sqrt(w @ sigma @ w) >= ((returns - 0.02) / np.sqrt(risks)).max() - 1e-4
    assert optimize.frontier_weights(mu, sigma, float(mu.max()) + 1, most) is None


def test_risk_parity_with_a_cap():
    _, sigma = _random_moments(5, 4)
    free = optimize.risk_parity(sigma)
    shares = free * (sigma @ free) / (free @ sigma @ free)
    assert shares == pytest.approx(np.full(4, 0.25), abs=1e-6)
    w = optimize.risk_parity(sigma, 0.3)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.3 + 1e-9


def test_price_pivot_refuses_repeats(spark):
    day = datetime.date(2024, 1, 1)
    bars = spark.createDataFrame([("A", day, 1.0), ("A", day, 2.0), ("B", day, 3.0)], "ticker string, date date, close double")
    with pytest.raises(Exception, match="repeated"):
        portfolio.price_pivot(bars, ["A", "B"]).collect()
    assert portfolio.price_pivot(bars, ["A", "B"], strict=False).collect()[0] == (day, 2.0, 3.0)


def test_book_sigma_is_the_double_sum(spark):
    rows = [("E", 0.2, 100.0), ("E", 0.3, -50.0), ("O", 0.4, 20.0), ("C", 0.1, 0.0)]
    s = [v / math.sqrt(252) * abs(m) for _, v, m in rows]
    want = sum(a * b * (1 if i == j else 0.35 if rows[i][0] == rows[j][0] else 0.10) for i, a in enumerate(s) for j, b in enumerate(s))
    got = portfolio.book_sigma(spark.createDataFrame(rows, "cls string, vol double, mv double")).first()
    assert got.sigma == pytest.approx(math.sqrt(want))


def test_checked_positions(spark):
    rows = [("a", "X", 1.0), ("a", " x", 2.0), ("b", "X", 0.0), ("c", "X", float("inf")), ("d", "X", 1.0), *[("e", f"s{i}", 1.0) for i in range(101)]]
    got = {r.owner: r.reason for r in portfolio.checked_positions(spark.createDataFrame(rows, "owner string, symbol string, quantity double")).collect()}
    assert got == {"a": "repeated symbol", "b": "quantity not finite or zero", "c": "quantity not finite or zero", "d": "ok", "e": "too many positions"}


def test_transition_analysis_of_a_known_matrix(spark):
    shares = spark.createDataFrame([("T", "A", "A", 0.5), ("T", "A", "B", 0.5), ("T", "B", "B", 2 / 3), ("T", "B", "A", 1 / 3)], "ticker string, before string, after string, share double")
    got = regimes.transition_analysis(shares, spark.createDataFrame([("T", "A"), ("U", "Z")], "ticker string, current string")).collect()
    one = {r.ticker: r for r in got}
    assert (one["T"].most_stable, one["T"].least_stable, one["T"].next_likely) == ("B", "A", "B")
    assert one["T"].stay_share == 0.5 and one["U"].next_likely == "Unknown" and one["U"].stay_share == 0.0


def test_tree_meets_the_formula(spark):
    q = spark.createDataFrame([(100.0, 95.0, 0.5, 0.05, 0.3, 0.01, True), (100.0, 110.0, 1.0, 0.02, 0.2, 0.0, False)], "s double, k double, t double, r double, v double, q double, call boolean")
    args = [F.col(c) for c in ("s", "k", "t", "r", "v", "q", "call")]
    for r in pricing.tree_prices(q, 400).withColumn("p", pricing.price(*args)).collect():
        assert r.tree == pytest.approx(r.p, abs=0.02)
    assert pricing.tree_prices(q.limit(0), 10).count() == 0


def test_options_refuse_wrong_inputs(spark):
    q = spark.createDataFrame([(100.0, -1.0, 1.0, 0.2)], "s double, k double, t double, v double")
    with pytest.raises(Exception, match="strike must be positive"):
        derivatives.validated(q).collect()
    assert derivatives.validated(q.limit(0)).count() == 0


def test_linear_surface_of_a_plane(spark):
    points = spark.createDataFrame([(t / 10, m / 10, 0.2 + t / 50 + m / 100) for t in range(1, 6) for m in range(-4, 5)], "t double, m double, iv double")
    rows = derivatives.linear_surface(points, 9, 17).collect()
    assert len(rows) == 153 and {r.source for r in rows} == {"linear"}
    assert all(r.iv == pytest.approx(0.2 + r.t / 5 + r.m / 10) for r in rows)
    one = derivatives.linear_surface(points.limit(1), 3, 3).collect()
    assert {r.source for r in one} == {"nearest"}


def test_strategy_breakevens(spark):
    legs = spark.createDataFrame([("x", True, "stock", 0.0, 1.0)], "key string, long boolean, kind string, strike double, qty double").select("*", *[F.lit(v).alias(c) for c, v in (("s", 100.0), ("v", 0.2), ("t", 1.0), ("r", 0.0), ("q", 0.0))])
    r = derivatives.strategies(legs).first()
    assert r.net_premium == 100.0 and r.net_delta == 1.0 and r.breakevens == [pytest.approx(100.0, abs=0.01)] and "short 1 shares" in r.hedges


def test_graph_keeps_first_nodes_and_turns_edges(spark):
    payload = '{"nodes":[{"id":"A1","label":"Alpha Ltd","category":"Supplier"},{"id":"x","label":"alpha"},{"id":"x","label":"Beta","category":"company"},{"label":"Gamma","category":"odd"}],"edges":[{"source":"acme","target":"a1","confidence":"1.4","relation":"r"},{"source":"a1","target":"x"},{"source":"nobody","target":"x"}]}'
    rows = spark.createDataFrame([(1, "Acme Inc", "ACME", payload), (2, "Solo", "", "no json")], "company int, name string, ticker string, payload string")
    g = graphs.nodes(rows)
    assert [(r.id, r.category) for r in graphs.node_rows(g).filter("company = 1").orderBy("position").collect()] == [("acme", "company"), ("a1", "supplier"), ("x", "subsidiary"), ("gamma", "related")]
    assert [r.id for r in graphs.node_rows(g).filter("company = 2").collect()] == ["solo"]
    got = {(r.source, r.target): (r.relation, r.confidence) for r in graphs.edges(g).collect()}
    assert got == {("a1", "acme"): ("supplies", 1.0), ("a1", "x"): ("related_to", 0.5)}


def test_dates_and_items(spark):
    rows = spark.createDataFrame([("05/02/2024",), ("2024-02-05T10:00",), ("05-02-2024",), ("20240205",), ("soon",), (None,)], "t string")
    got = [r[0] for r in rows.select(evidence.parsed_date(F.col("t"))).collect()]
    assert got == [datetime.date(2024, 2, 5)] * 4 + [None, None]
    items = spark.createDataFrame([('{"content":{"title":"T","provider":{},"relatedTickers":["a",null]}}',), ('{"title":""}',), ("{",), (None,)], "payload string")
    assert [(r.title, r.publisher, r.related) for r in evidence.parsed_items(items).collect()] == [("T", "—", ["A"])]


def test_addresses(spark):
    import urllib.parse

    base = "https://site.org/a/b/page.html?x=1"
    urls = ["http://z/q", "/abs/x?y=1#f", "rel.html", "../up.pdf", "./here/", "//host/p", "?only=query", "../../../top", "a/./b/../c"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(filings.absolute_url(F.col("u"), F.lit(base))).collect()]
    assert got == [u if u.startswith("http") else urllib.parse.urljoin(base, u) for u in urls]


def test_contexts_and_citations(spark):
    rows = spark.createDataFrame([("k", 1, " one\ntwo ", "f.pdf", 3), ("k", 2, "word " * 400, None, None)], "k string, rank int, text string, source_file string, page_number int")
    text = filings.numbered_context(rows, "k").first().context
    first, second = text.split("\n\n")
    assert first == "[1] (f.pdf (Page 3))\none two" and second.startswith("[2] (Unknown (Page N/A))\nword") and second.endswith("word ...")
    one = spark.range(1).select(filings.cited(F.lit("[3] [1] [9] [3] [x]"), 3).alias("c")).first()
    assert one.c == [3, 1]


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, [3.0, 4.0], 1), (1, [1.0, 0.0], 1), (2, [0.6, 0.8], 0), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    filings.save_index(filings.index(rows), f"{tmp_path}/index")
    back = filings.load_index(spark, f"{tmp_path}/index")
    assert [r.vec_id for r in filings.retrieved(back, 0, 2, {"label": 1}).collect()] == [0, 1]
    assert filings.retrieved(back, 99, 2).count() == 0


def test_engine_enters_after_the_first_row(spark):
    day = datetime.date(2024, 1, 1)
    closes = [10.0, 11.0, 12.0, 9.0, 9.0, 12.0]
    bars = spark.createDataFrame([("X", day + datetime.timedelta(i), c, c, c, c, 1.0) for i, c in enumerate(closes)], "ticker string, date date, open double, high double, low double, close double, volume double")
    rows = backtest.engine(bars, [], [], {"kind": "FIXED", "percent": 100}, take=0.2, stop=0.1).orderBy("date").collect()
    assert [r.held for r in rows] == [0, 0, 1, 1, 0, 1] and [r.exited for r in rows] == [False, False, False, True, False, True]
    with pytest.raises(ValueError):
        backtest.indicators(bars, [{"type": "rsi_bellow"}])
    with pytest.raises(ValueError):
        backtest.measure({"kind": "SAR"})


def test_saved_models(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i + 1) for i in range(60)], "a double, b double, y double")
    model = learn.fitted(rows, ["a", "b"], learn.regressors()["linear_regression"])
    assert [(r.rank, r.feature) for r in learn.importance(model, ["a", "b"], spark).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    learn.save_model(model, f"{tmp_path}/m")
    assert learn.load_model(f"{tmp_path}/m").transform(rows).filter("abs(prediction - y) > 1e-6").count() == 0


@pytest.mark.parametrize("name", ["search_rerank", "text_sentiment", "text_overall_sentiment", "text_factor_scores", "text_metadata", "text_news_impact", "text_segments", "records_health_days"])
def test_texts_are_told_apart(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(len({r[c] for r in rows}) > 1 for c in rows[0].asDict())
