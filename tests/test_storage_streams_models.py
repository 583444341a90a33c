"""Stored bars, streams, simulations, weights and regimes."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hidden_markov, learn, optimize, research, simulate
from tidemark.sources import bars, storage
from tidemark.streaming.bars import bars as stream_bars
from tidemark.streaming.bars import event_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_bars_round_trip(spark, tmp_path, kind):
    rows = bars.weekly_bars(spark, SF)
    storage.save_bars(rows, f"{tmp_path}/bars", kind)
    got = storage.load_bars(spark, f"{tmp_path}/bars", kind)
    assert sorted(map(tuple, got.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    plan = got.filter("ticker = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan


def test_texts_and_catalog(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    (tmp_path / "y.csv").write_text("a,b\n")
    assert [tuple(r) for r in storage.load_texts(spark, str(tmp_path)).collect()] == [("x.txt", "one\ntwo")]
    assert [(r.name, r.kind, r.bytes) for r in storage.catalog(spark, str(tmp_path)).collect()] == [("y.csv", "csv", 4)]


def test_stream_gives_the_bars_of_the_batch(spark, tmp_path):
    events = bars.table(spark, SF, "events")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = stream_bars(event_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("stream_bars_test").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("stream_bars_test").select("ticker", "ts", "open", "close", "volume").collect()))
    assert got == sorted(map(tuple, bars.tick_bars(spark, SF).select("ticker", "ts", "open", "close", "volume").collect()))


def test_simulated_paths(spark):
    rows = simulate.paths(spark, 100.0, 0.07, 0.2, 1.0, 12, 20_000).cache()
    s = simulate.summary(rows, 100.0).first()
    assert s["mean"] == pytest.approx(100 * np.exp(0.07), rel=0.01)
    assert s["median"] == pytest.approx(100 * np.exp(0.05), rel=0.01)
    again = simulate.paths(spark, 100.0, 0.07, 0.2, 1.0, 12, 20_000).repartition(7)
    assert again.agg(F.sum("price")).first()[0] == pytest.approx(rows.agg(F.sum("price")).first()[0])
    area = simulate.densities(rows, 4, 10).withColumn("next", F.col("density")).groupBy("step").count().collect()
    assert len(area) == 4


def test_weights():
    sigma = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.16]])
    mu = np.array([0.10, 0.12, 0.08])
    w = optimize.minimum_variance(sigma)
    best = np.linalg.solve(sigma, np.ones(3))
    assert w == pytest.approx(best / best.sum(), abs=1e-4)
    w = optimize.risk_parity(sigma)
    part = w * (sigma @ w)
    assert part == pytest.approx(np.full(3, part.mean()), rel=1e-5)
    sharpe = lambda w: (w @ mu - 0.05) / np.sqrt(w @ sigma @ w)
    tangent = np.linalg.solve(sigma, mu - 0.05)
    assert sharpe(optimize.maximum_sharpe(mu, sigma)) >= 0.99 * sharpe(tangent / tangent.sum())
    assert optimize.minimum_variance(sigma, 0.4).max() <= 0.4 + 1e-9


def test_regimes_are_found(spark):
    rng = np.random.default_rng(2)
    day = datetime.date(2020, 1, 1)
    calm = np.concatenate([rng.normal(0.01, 0.005, 150), rng.normal(-0.03, 0.02, 100), rng.normal(0.01, 0.005, 150)])
    rows = spark.createDataFrame([("X", day + datetime.timedelta(i), float(v)) for i, v in enumerate(calm)], "ticker string, date date, r double")
    got = np.array([r.state for r in hidden_markov.detected(rows, ["r"], 2).orderBy("date").collect()])
    assert (got[:150] == 1).mean() > 0.9 and (got[150:250] == 0).mean() > 0.9
    assert hidden_markov.detected(rows.limit(0), ["r"], 2).count() == 0


def test_walk_forward_sees_the_past_only(spark):
    rng = np.random.default_rng(3)
    day = datetime.date(2020, 1, 1)
    x = rng.normal(size=200)
    rows = spark.createDataFrame([("X", day + datetime.timedelta(i), float(v), int(v + rng.normal(0, 0.3) > 0)) for i, v in enumerate(x)], "ticker string, date date, f double, y int")
    out = learn.walk_forward(rows, ["f"], step=20)
    assert out.count() == 80 and learn.scores(out, ["ticker"]).first().auc > 0.9


def test_brackets(spark):
    day = datetime.date(2024, 1, 1)
    closes = [100.0, 105.0, 111.0, 100.0, 91.0, 95.0]
    rows = spark.createDataFrame([("X", day + datetime.timedelta(i), c, True, False) for i, c in enumerate(closes)], "ticker string, date date, close double, enter boolean, leave boolean")
    assert [(r.reason, round(r.trade_return, 2)) for r in research.bracketed(rows, 0.1, 0.08).orderBy("entry").collect()] == [("take", 0.11), ("stop", -0.09)]


def test_cached_results_last_for_a_while(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    once = storage.cached(spark, str(tmp_path), "k", 3600, make)
    assert storage.cached(spark, str(tmp_path), "k", 3600, make).count() == once.count() == 1
    assert storage.cached(spark, str(tmp_path), "other", 3600, make).count() == 2
    assert storage.cached(spark, str(tmp_path), "k", 0, make).count() == 3


def test_factor_records(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.date(2024, 1, 2), "A", *[i / 10 for i in range(9)])], storage.FACTORS)
    storage.save_factors(rows, f"{tmp_path}/f")
    assert [tuple(r) for r in storage.load_factors(spark, f"{tmp_path}/f").collect()] == [tuple(r) for r in rows.collect()]


def test_providers_by_name(spark):
    from tidemark.sources.providers import provider

    assert provider(" Weekly ") is bars.weekly_bars
    with pytest.raises(ValueError, match="segments"):
        provider("nobody")
