"""Decimals and sums that come out as the exact arithmetic of doubles says."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import one_decimal, rounded_product
from tidemark.operators import desk, text
from tidemark.plans import text as plans


def test_one_decimal_rounds_the_exact_value(spark):
    rng = np.random.default_rng(5)
    ties = (2 * np.arange(1000) + 1) / 20
    x = np.concatenate([[0.0, 6.25, 81.25, 0.35, 56.45, 1.15, 99.95, 99.96, 100.0], ties, np.nextafter(ties, 0), np.nextafter(ties, 200), rng.uniform(0, 100, 2000), np.arange(1000) / 10, np.nextafter(np.arange(1, 1000) / 10, 0)])
    x = np.concatenate([x, -x[1:50]]).tolist()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v double").select("i", one_decimal(F.col("v")).alias("t")).orderBy("i").collect()
    assert [(v, r.t) for v, r in zip(x, got) if r.t != f"{v:.1f}"] == []


def test_explanations_round_ties_as_sql_does(spark):
    rows = spark.createDataFrame([(0.8125, "Weak"), (0.0625, "Strong")], "p double, quality string")
    told = [r.explanation for r in desk.institutional(rows).select("explanation").collect()]
    assert "(81.2%)" in told[0] and "is 6.2%." in told[1]


def test_overall_sentiment_adds_in_order(spark):
    # added in the order of k: 0.1 + 0.2 + 0.3 is above 0.6, 0.3 + 0.2 + 0.1 is not
    for scores in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)):
        want = (scores[0] + scores[1] + scores[2]) / 3
        rows = [(1, k, s, "positive") for k, s in enumerate(scores)]
        for shuffled in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
            df = spark.createDataFrame(shuffled, "g long, k long, score double, label string").repartition(3)
            assert text.overall_sentiment(df, "g", "k").first().score == want


@pytest.mark.parametrize("stored", ["hash(o_orderkey)", "o_custkey, o_totalprice", "i, o_orderkey"])
def test_overall_sentiment_adds_as_orders_are_stored(spark, tmp_path, stored):
    # files whose rows do not lie by key, in small row groups, or hold a key twice; the SQL on one thread adds row after row
    times = 2 if stored.startswith("i,") else 1
    duck = duckdb.connect(config={"threads": 1})
    rows = duck.sql(f"SELECT o.* FROM '/root/testdata/sf0.01/orders.parquet' o, range({times}) r(i) ORDER BY {stored}").to_arrow_table()
    pq.write_table(rows, tmp_path / "orders.parquet", row_group_size=4000)
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = duck.execute(plans.ORACLE_SQL["text_overall_sentiment"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in plans.overall(spark, str(tmp_path)).collect())
    assert len(got) == len(want) and [x for x in zip(got, want) if x[0] != x[1]] == []


def test_rounded_product_rounds_as_duckdb(spark):
    x = [0.0645625, 0.1949375, -0.0645625, 0.5, 2.5e-7, 5e-7, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v double").orderBy("i").select(rounded_product("v")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in x]
