"""Folds see the past only; scores equal single fits, however many run at once."""

import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import walk_forward as W
from tidemark.operators.learn import regressors

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for t, n in (("A", 40), ("B", 50)):
        for i in range(n):
            a, b = rng.normal(size=2)
            data.append((t, DAY + datetime.timedelta(days=i), float(a), float(b), float(2 * a - b + 0.1 * rng.normal())))
    return spark.createDataFrame(data, "ticker string, date date, a double, b double, y double").cache()


def test_folds(spark, rows):
    got = W.folds(rows, first=0.5, step=8).orderBy("group", "fold").collect()
    assert [(r.group, r.fold, r.train_rows, r.test_rows) for r in got] == [("A", 0, 20, 8), ("A", 1, 28, 8), ("A", 2, 36, 4), ("B", 0, 25, 8), ("B", 1, 33, 8), ("B", 2, 41, 8), ("B", 3, 49, 1)]
    assert all(r.train_last < r.test_first <= r.test_last for r in got)
    both = W.folds(rows, first=0.5, step=20, together=True).orderBy("fold").collect()
    assert [(r.train_rows, r.test_rows) for r in both] == [(50, 35), (85, 5)]
    assert W.folds(rows.limit(0)).count() == 0 and W.folds(rows.limit(1)).count() == 0


def test_regression_equals_single_fits(spark, rows):
    out = {(r.ticker, r.date): r for r in W.walk_forward(rows, ["a", "b"], "random_forest", kind="regression", first=0.5, step=13, at_once=3).collect()}
    assert len(out) == 45 and all(r.p is None for r in out.values())
    for f in W.folds(rows, first=0.5, step=13).collect():
        own = rows.filter(F.col("ticker") == f.group)
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), regressors()["random_forest"]]).fit(own.filter(F.col("date") <= f.train_last))
        for r in model.transform(own.filter(F.col("date").between(f.test_first, f.test_last))).collect():
            assert out[r.ticker, r.date].prediction == pytest.approx(r.prediction) and out[r.ticker, r.date].fold == f.fold


def test_classification(spark, rows):
    y = rows.withColumn("y", (F.col("y") > 0).cast("int"))
    one = W.walk_forward(y, ["a", "b"], "logistic", together=True, first=0.5, step=13, at_once=1).orderBy("ticker", "date").collect()
    many = W.walk_forward(y, ["a", "b"], "logistic", together=True, first=0.5, step=13, at_once=8).orderBy("ticker", "date").collect()
    assert [r.p for r in one] == [r.p for r in many] and len(one) == 40
    assert sum((r.p >= 0.5) == bool(r.y) for r in one) > 36
    # a fold whose past knows one label is passed over
    late = y.withColumn("y", (F.col("date") >= DAY + datetime.timedelta(days=35)).cast("int"))
    assert {r.fold for r in W.walk_forward(late, ["a", "b"], "logistic", together=True, first=0.5, step=13).collect()} == {1}
    assert W.walk_forward(y.limit(0), ["a", "b"], "logistic").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        W.walk_forward(y, ["a"], "no such")
