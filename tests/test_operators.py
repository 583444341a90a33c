"""Operators on small literal frames: known values, and empty, single, null and constant input."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import cumulative
from tidemark.operators import backtest, features, pricing, records, stats, text
from tidemark.plans import research

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="X"):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(ticker, day + datetime.timedelta(i), c, c, c, c, 1.0) for i, c in enumerate(closes)], BARS)


def column(df, c):
    return [r[0] for r in df.orderBy("date").select(c).collect()]


def test_returns_and_drawdown(spark):
    out = features.enriched(bars(spark, [100.0, 110.0, 99.0, 99.0]))
    assert column(out, "simple_return") == [None, pytest.approx(0.1), pytest.approx(-0.1), 0.0]
    assert column(out, "drawdown") == [0.0, 0.0, pytest.approx(-0.1), pytest.approx(-0.1)]
    assert column(out, "cumulative_return")[-1] == pytest.approx(-0.01)
    assert column(out, "rolling_volatility") == [None] * 4


def test_log_return_of_prices_that_are_not_positive_is_null(spark):
    assert column(features.returns(bars(spark, [100.0, 0.0, 50.0])), "log_return") == [None, None, None]


def test_empty_and_single_bars(spark):
    empty, one = bars(spark, []), bars(spark, [5.0])
    for f in (features.enriched, features.technicals, features.exponential, features.volumes, stats.summary, stats.value_at_risk, stats.drawdown_episodes):
        assert f(empty).count() == 0
    assert stats.summary(one).first().volatility == 0.0
    assert stats.value_at_risk(one).count() == 0
    assert column(features.exponential(one), "ema_9") == [5.0]


def test_rolling_matches_pandas(spark):
    x = np.random.default_rng(1).uniform(50, 150, 80).tolist()
    s = pd.Series(x)
    out = features.technicals(features.averages(bars(spark, x), (10, 20)))
    for got, want in ((column(out, "sma_10"), s.rolling(10).mean()), (column(out, "bollinger_upper"), s.rolling(20).mean() + 2 * s.rolling(20).std())):
        assert [math.nan if v is None else v for v in got] == pytest.approx(want.tolist(), nan_ok=True)
    d = s.diff()
    rs = d.clip(lower=0).rolling(14).mean() / (-d.clip(upper=0)).rolling(14).mean()
    assert [math.nan if v is None else v for v in column(out, "rsi_14")] == pytest.approx((100 - 100 / (1 + rs)).tolist(), nan_ok=True)
    ema = features.exponential(bars(spark, x))
    assert column(ema, "ema_12") == pytest.approx(s.ewm(span=12, adjust=False).mean().tolist())


def test_sharpe_of_a_constant_series_is_null(spark):
    assert stats.summary(bars(spark, [5.0, 5.0, 5.0])).first().sharpe is None


def test_positions_match_a_loop(spark):
    rng = np.random.default_rng(4)
    n = 400
    e, x = rng.random(n) < 0.3, rng.random(n) < 0.3
    day = datetime.date(2020, 1, 1)
    rows = spark.createDataFrame([("X", day + datetime.timedelta(i), bool(a), bool(b)) for i, (a, b) in enumerate(zip(e, x))], "ticker string, date date, e boolean, x boolean")
    want, state = [0], 0
    for a, b in zip(e[:-1], x[:-1]):
        state = 1 if state == 0 and a else 0 if state == 1 and b else state
        want.append(state)
    assert column(backtest.positions(rows, F.col("e"), F.col("x")), "position") == want


def test_runs_and_transitions(spark):
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([("X", day + datetime.timedelta(i), s) for i, s in enumerate("AABBBAA")], "ticker string, date date, s string")
    assert [r.length for r in stats.runs(rows, "s").orderBy("first_date").collect()] == [2, 3, 2]
    shares = {(r.before, r.after): r.share for r in stats.transitions(rows, "s").collect()}
    assert shares[("A", "A")] == pytest.approx(2 / 3) and shares[("B", "A")] == pytest.approx(1 / 3)


def test_normal_and_option_prices(spark):
    row = spark.range(1).select(*[cumulative(F.lit(v)).alias(f"c{i}") for i, v in enumerate((-1.5, 0.0, 2.0))],
                                pricing.price(*map(F.lit, (100.0, 100.0, 1.0, 0.05, 0.2, 0.0, True))).alias("p")).first()
    assert [row.c0, row.c1, row.c2] == pytest.approx([0.0668072, 0.5, 0.9772499], abs=1e-6)
    assert row.p == pytest.approx(10.450584, abs=1e-4)
    q = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip("sktrvq", (100.0, 110.0, 0.5, 0.05, 0.27, 0.0))], F.lit(True).alias("call"))
    a = [F.col(c) for c in "sktrvq"]
    p = q.withColumn("price", pricing.price(*a, F.col("call"))).withColumn("iv", pricing.implied_volatility(F.col("price"), a[0], a[1], a[2], a[3], a[5], F.col("call")))
    r = pricing.tree_prices(p, 400).first()
    assert r.iv == pytest.approx(0.27, abs=1e-4) and r.tree == pytest.approx(r.price, abs=0.05)
    assert p.select(pricing.implied_volatility(F.lit(500.0), a[0], a[1], a[2], a[3], a[5], F.col("call"))).first()[0] is None


def test_forward_fill_and_as_of(spark):
    d = lambda i: datetime.date(2024, 1, i)
    rows = spark.createDataFrame([("A", d(1)), ("A", d(2)), ("A", d(3)), ("B", d(2))], "ticker string, date date")
    facts = spark.createDataFrame([("A", d(2), 0.8)], "ticker string, date date, v double")
    assert [tuple(r) for r in records.forward_filled(rows, facts, ["ticker"], "date", ["v"]).orderBy("ticker", "date").select("v").collect()] == [(0.0,), (0.8,), (0.8,), (0.0,)]
    assert [r.v for r in records.as_of(rows, facts, "ticker", "date", "v").orderBy("ticker", "date").collect()] == [None, 0.8, 0.8, None]


def test_licences(spark):
    d = lambda i: datetime.date(2024, 1, i)
    wanted = spark.createDataFrame([(i,) for i in range(6)], "dataset int")
    registered = spark.createDataFrame([(i,) for i in range(1, 6)], "dataset int")
    grants = spark.createDataFrame([(2, "active", d(1), d(20)), (3, "active", d(18), None), (4, "active", None, d(15)), (5, "revoked", None, None)], "dataset int, status string, starts_at date, ends_at date")
    got = {r.dataset: r.status for r in records.licences(wanted, registered, grants, F.lit(d(15))).collect()}
    assert got == {0: "NOT_REGISTERED", 1: "NOT_GRANTED", 2: "ACTIVE", 3: "PENDING", 4: "EXPIRED", 5: "REVOKED"}


def test_sentiment_and_chunks(spark):
    rows = spark.createDataFrame([(1, "Profits surge; record growth"), (2, "Shares fall on weak demand"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.label for r in text.sentiment(rows).collect()} == {1: "positive", 2: "negative", 3: "neutral"}
    body = "word " * 400
    out = text.chunks(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.start for r in out][:3] == [0, 650, 1300] and {r.doc_id for r in out} == {1} and all(len(r.chunk) <= 800 for r in out)


def test_bm25_without_the_words(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert text.bm25(rows, "zzz").count() == 0


def test_pages_keep_long_texts_whole(spark):
    page = spark.createDataFrame([("<p>" + "ab " * 200_000 + "end</p>",)], "html string")
    assert page.select(F.length(text.plain_text(F.col("html")))).first()[0] == 600_003
    assert page.select(F.length(text.plain_text(F.col("html"), 10))).first()[0] == 10


def test_health_counts_every_event(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.user_id: r.n for r in research.health(spark, sf).collect()}
    assert got == {r.user_id: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}


def test_macd_conditions(spark):
    closes = [100 + 10 * math.sin(i / 4) + i / 5 for i in range(60)]
    rows = bars(spark, closes).unionByName(bars(spark, closes[::-1], "Y"))
    out = backtest.indicators(rows, [{"type": "macd_above_signal"}, {"type": "momentum_above", "period": 1}, {"type": "macd_below_signal"}])
    assert out.columns == [*rows.columns, "c0", "c1", "c2"] and out.count() == 120
    for ticker, own in (("X", closes), ("Y", closes[::-1])):
        c = pd.Series(own)
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        signal = macd.ewm(span=9, adjust=False).mean()
        got = out.filter(F.col("ticker") == ticker)
        assert column(got, "c0") == (macd > signal).tolist() and column(got, "c2") == (macd < signal).tolist()
        assert any(column(got, "c0")) and any(column(got, "c2"))


def test_implied_volatilities_are_found_in_batches_and_by_many_tasks(spark, tmp_path):
    from tidemark.plans import market

    a = [F.col(c) for c in ("s", "k", "t", "r", "v", "q")]
    rows = spark.range(3000).select(F.lit(100.0).alias("s"), (80.0 + F.col("id") % 40).alias("k"), F.lit(0.5).alias("t"), F.lit(0.03).alias("r"), (0.1 + F.col("id") / 5000).alias("v"), F.lit(0.01).alias("q"), (F.col("id") % 2 == 0).alias("call"))
    found = rows.withColumn("iv", pricing.implied_volatility(pricing.price(*a, F.col("call")), a[0], a[1], a[2], 0.03, a[5], F.col("call")))
    assert found.filter("abs(iv - v) > 1e-6").count() == 0
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    missing = rows.withColumn("v", F.lit(None).cast("double")).withColumn("iv", pricing.implied_volatility(F.col("v"), a[0], a[1], a[2], 0.03, a[5], F.col("call")))
    assert missing.filter("iv is not null").count() == 0
    # parts in one file
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), (900.0 + F.col("id") % 1000).alias("p_retailprice"), F.lit(5).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        quotes = market._quotes(spark, str(tmp_path))
        assert sum(quotes.select("v").rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect()) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
