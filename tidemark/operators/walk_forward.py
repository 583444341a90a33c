"""Walk-forward validation of any model of the registries: each fold is fitted to all rows before it.

Folds are rows of a plan. Features are assembled once; each fold is a fit of Spark's over a filter of that frame, and a pool of
driver threads keeps several fits running, so that a cluster is not idle while one small fit ends. A fold belongs to a group:
a ticker, or all tickers together, cut by date. Fits are as many as groups times folds; with thousands of tickers take them
together, or learn.walk_forward, which fits a ticker inside a task.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.learn import models, regressors

FOLD = "group string, fold int, train_rows long, test_rows long, train_first date, train_last date, test_first date, test_last date"


def placed(rows: DataFrame, together: bool = False) -> DataFrame:
    """rows with group and place: the number of a row's date within its group, from 0."""
    rows = rows.withColumn("group", F.lit("all") if together else F.col("ticker").cast("string"))
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("group").orderBy("date")) - 1)


def folds(rows: DataFrame, *, first: float = 0.6, step: int = 30, together: bool = False) -> DataFrame:
    """FOLD: of each group the first part of its dates is trained on, the next `step` dates are tested, and so on to the end; the training
    rows grow. Groups whose first part is empty or all have no folds."""
    rows = placed(rows, together)
    # one row for each group
    ends = rows.groupBy("group").agg((F.max("place") + 1).alias("n")).withColumn("start", F.floor(F.col("n") * first).cast("int"))
    ends = ends.filter("start > 0 and start < n")
    cuts = ends.withColumn("fold", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - F.col("start") - 1) / step).cast("int"))))
    cuts = cuts.withColumn("at", F.col("start") + F.col("fold") * step)
    # rows of a date are counted first; a date meets its group's folds
    dates = rows.groupBy("group", "place", "date").agg(F.count(F.lit(1)).alias("k"))
    met = dates.join(cuts, "group").filter(F.col("place") < F.col("at") + step)
    train, test = F.col("place") < F.col("at"), F.col("place") >= F.col("at")
    return met.groupBy("group", "fold").agg(
        F.sum(F.when(train, F.col("k"))).alias("train_rows"), F.sum(F.when(test, F.col("k"))).alias("test_rows"),
        F.min(F.when(train, F.col("date"))).alias("train_first"), F.max(F.when(train, F.col("date"))).alias("train_last"),
        F.min(F.when(test, F.col("date"))).alias("test_first"), F.max(F.when(test, F.col("date"))).alias("test_last"),
    )


def walk_forward(
    rows: DataFrame, features: list[str], model: str, *, kind: str = "classification", first: float = 0.6, step: int = 30,
    together: bool = False, at_once: int = 4, seed: int = 42,
) -> DataFrame:
    """(ticker, date, group, fold, y, prediction, p) of the rows of all folds; p: the probability of 1, null for a regression.

    rows: ticker, date, features, y; rows with a missing one are left out before folds are cut. A classification's fold whose
    training rows have one label is passed over. Linear models see standardized features, by their training rows. At most
    `at_once` folds are fitted at a time.
    """
    registry = models(seed) if kind == "classification" else regressors(seed) if kind == "regression" else None
    if registry is None or model not in registry:
        raise ValueError(f"unknown {kind} {model!r}")
    chosen = registry[model]
    rows = placed(rows.dropna(subset=[*features, "y"]), together)
    frame = VectorAssembler(inputCols=features, outputCol="raw").transform(rows).select("ticker", "date", "group", "y", "raw")
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    plan = folds(rows, first=first, step=step, together=together).orderBy("group", "fold").collect()
    stages = [StandardScaler(inputCol="raw", outputCol="x", withMean=True)] if model.startswith(("logistic", "linear")) else []
    columns = frame if stages else frame.withColumn("x", F.col("raw"))

    def fitted(fold):
        own = columns.filter(F.col("group").eqNullSafe(F.lit(fold.group)))
        train = own.filter(F.col("date") <= fold.train_last)
        if kind == "classification" and train.select("y").distinct().limit(2).count() < 2:
            return None
        found = Pipeline(stages=[*stages, chosen.copy()]).fit(train)
        test = found.transform(own.filter(F.col("date").between(fold.test_first, fold.test_last)))
        p = vector_to_array("probability")[1] if kind == "classification" else F.lit(None).cast("double")
        return test.select("ticker", "date", "group", F.lit(fold.fold).alias("fold"), "y", "prediction", p.alias("p"))

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        parts = [p for p in pool.map(fitted, plan) if p is not None]
    if not parts:
        empty = columns.limit(0).select("ticker", "date", "group", F.lit(0).alias("fold"), "y", F.lit(0.0).alias("prediction"), F.lit(None).cast("double").alias("p"))
        return empty
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
