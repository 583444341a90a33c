"""Long histories in blocks give what whole histories give, in many tasks."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date, rolling
from tidemark.operators import backtest, features, research
from tidemark.operators.histories import framed, numbered, running

DAY = datetime.date(2001, 1, 1)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, n, tickers=("A",), seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        # gaps of several years leave whole periods empty
        days = np.cumsum(rng.choice([1, 2, 900], n, p=[0.7, 0.29, 0.01]))
        for d, c in zip(days.tolist(), close.tolist()):
            c = None if rng.random() < missing else c
            rows.append((t, DAY + datetime.timedelta(days=d), c, c, c, c, float(rng.integers(1, 9))))
    return spark.createDataFrame(rows, BARS).repartition(5)


def same(a, b, keys=("ticker", "date")):
    order = list(keys)
    a, b = (x.toPandas().sort_values(order, ignore_index=True)[sorted(a.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size,days", [(7, 11), (64, 400), (100_000, 3653)])
def test_blocks_give_what_tickers_give(spark, size, days):
    rows = bars(spark, 300, ("A", "B", None))
    how = {"size": size, "days": days}
    same(features.in_blocks(rows, lambda b: features.volatility(features.returns(b)), back=61, **how), features.volatility(features.returns(rows)))
    same(features.in_blocks(rows, lambda b: features.targets(features.returns(b)), back=6, ahead=5, **how), features.targets(features.returns(rows)))
    same(features.in_blocks(rows, features.averages, back=199, **how), features.averages(rows))
    same(features.enriched(rows, **how), features.enriched(rows))
    same(features.exponential(rows, **how), features.exponential(rows))
    got = running(numbered(rows, **how), {"s": ("sum", F.col("volume")), "lo": ("min", F.col("close")), "l": ("last", F.when(F.col("volume") > 7, F.col("volume")))})
    w = by_date().rowsBetween(-1000, 0)
    want = rows.withColumns({"s": F.sum("volume").over(w), "lo": F.min("close").over(w), "l": F.last(F.when(F.col("volume") > 7, F.col("volume")), True).over(w)})
    same(got.drop("_pos", "_block", "_key"), want)


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_recurrences(spark, size):
    rows = bars(spark, 200, ("A", "B"), seed=size, missing=0.1)
    ema = features.exponential(rows, (9, 12), size=size, days=100).toPandas().sort_values(["ticker", "date"])
    plain = rows.toPandas().sort_values(["ticker", "date"])
    for t in ("A", "B"):
        x, own = plain[plain.ticker == t]["close"].astype(float), ema[ema.ticker == t]
        mean = lambda v, n: v.ewm(span=n, adjust=False, ignore_na=True).mean()
        assert np.allclose(own["ema_9"], mean(x, 9), equal_nan=True)
        macd = mean(x, 12) - mean(x, 26)
        assert np.allclose(own["macd_signal"], mean(macd, 9), equal_nan=True)
    rows = rows.filter("close is not null")
    plain = rows.toPandas().sort_values(["ticker", "date"])
    dev = research.ewm_deviation(rows, size=size, days=100).toPandas().sort_values(["ticker", "date"])
    var = research.rolling_value_at_risk(rows, 30, 0.9, size=size, days=100).toPandas().sort_values(["ticker", "date"])
    root = research.ewma(rows, size=size, days=100).toPandas().sort_values(["ticker", "date"])
    for t in ("A", "B"):
        r = plain[plain.ticker == t]["close"].astype(float).pct_change().dropna()
        mine = lambda f, c: f[f.ticker == t][c].astype(float)
        assert np.allclose(mine(dev, "ewm_deviation"), r.ewm(alpha=0.06, adjust=False).std() * 252**0.5, equal_nan=True)
        assert np.allclose(mine(var, "var"), -r.rolling(30).quantile(0.1), equal_nan=True)
        assert np.allclose(mine(root, "ewma_vol"), (r**2).ewm(alpha=0.06, adjust=False).mean() ** 0.5 * 252**0.5)


@pytest.mark.parametrize("size", [3, 50])
def test_positions(spark, size):
    rng = np.random.default_rng(size)
    n = 150
    flags = [(t, DAY + datetime.timedelta(days=3 * i), bool(rng.random() < 0.3), bool(rng.random() < 0.3)) for t in "AB" for i in range(n)]
    rows = spark.createDataFrame(flags, "ticker string, date date, e boolean, x boolean").repartition(3)
    got = {(r.ticker, r.date): r.position for r in backtest.positions(rows, F.col("e"), F.col("x"), size=size, days=30).collect()}
    for t in "AB":
        state, before = 0, (False, False)
        for _, d, e, x in [f for f in flags if f[0] == t]:
            state = 1 if not state and before[0] else 0 if state and before[1] else state
            assert got[t, d] == state
            before = (e, x)


def test_one_ticker_runs_in_many_tasks(spark):
    rows = bars(spark, 1200)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        out = framed(numbered(rows, size=100, days=200), lambda b: b.withColumn("m", rolling(F.avg, "close", 20)), back=19, size=100)
        assert out.groupBy("_block").count().count() == 12
        tasks = lambda df: sum(df.select("m").rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect())
        assert tasks(out) > 6
        whole = rows.withColumn("m", rolling(F.avg, "close", 20))
        assert tasks(whole) == 1
        # windows by ticker alone see counts or values of blocks, never rows
        for df in (features.enriched(rows, size=100, days=200), features.exponential(rows, size=100, days=200)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            by_key = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(_key" in line]
            assert all("_block" in line or "_period" in line for line in by_key)
            assert "windowspecdefinition(ticker" not in plan
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_few_rows_are_dealt_by_block(spark):
    # whichever side of a join is done first, small rows are not broadcast to the values of their blocks, which lie by ticker
    rows = numbered(bars(spark, 60), size=10, days=100)
    for df in (framed(rows, lambda b: b.withColumn("m", rolling(F.avg, "close", 5)), back=4, size=10), running(rows, {"s": ("sum", F.col("volume"))})):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BroadcastHashJoin" not in plan and "_block" in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_empty_and_repeated_dates(spark):
    rows = bars(spark, 20)
    for f in (features.enriched, features.exponential, research.ewm_deviation, research.rolling_value_at_risk):
        assert f(rows.limit(0)).count() == 0
    twice = rows.unionByName(rows)
    assert features.exponential(twice, size=7, days=5).count() == 40 and features.enriched(twice, size=7, days=5).count() == 40
    rules = [{"left": {"kind": "PRICE"}, "op": ">", "right": {"kind": "CONST", "value": 1}}]
    assert backtest.engine(twice, rules, [], {"kind": "FIXED", "percent": 50}).count() == 40
