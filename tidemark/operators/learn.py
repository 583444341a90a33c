"""Models of returns: chronological splits, expanding-window validation, model comparison, and market regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ratio
from tidemark.operators.hidden_markov import detected
from tidemark.operators.histories import DAYS, SIZE

BINS = 1024  # parts of the range of probabilities in which ranks are counted side by side


def models(seed: int = 42) -> dict:
    return {
        "logistic": LogisticRegression(featuresCol="x", labelCol="y", maxIter=50), "random_forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=30, maxDepth=5, seed=seed),
        "gradient_boosting": GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, seed=seed),
    }


def regressors(seed: int = 42) -> dict:
    return {
        "linear_regression": LinearRegression(featuresCol="x", labelCol="y", solver="normal"),
        "random_forest": RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=30, maxDepth=5, seed=seed),
        "gradient_boosting": GBTRegressor(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, seed=seed),
    }


def fitted(rows: DataFrame, features: list[str], model) -> PipelineModel:
    """A pipeline that assembles the features and fits a model to y."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), model]).fit(rows.dropna(subset=[*features, "y"]))


def importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(rank, feature, importance) of a fitted pipeline: importances of trees, coefficients of linear models, largest in size first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray() if hasattr(last, "coefficients") else np.zeros(len(features))
    rows = sorted(zip(features, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)], "rank int, feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def regression_suite(rows: DataFrame, features: list[str], test_size: float = 0.2) -> DataFrame:
    """Every regressor fitted to the first rows and scored on the last, by root mean square error. rows: ticker, date, features, y."""
    rows = chronological(rows.dropna(subset=[*features, "y"]), test_size)
    out = None
    for name, model in regressors().items():
        p = fitted(rows.filter("train"), features, model).transform(rows.filter("not train"))
        one = regression_scores(p.select("y", F.col("prediction").alias("p")), "y", "p").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse")))  # one row per model


def chronological(rows: DataFrame, test_size: float = 0.2) -> DataFrame:
    """rows with train: true for the first rows of each ticker."""
    by = Window.partitionBy("ticker")
    return rows.withColumn("train", F.row_number().over(by.orderBy("date")) <= F.floor(F.count(F.lit(1)).over(by) * (1 - test_size)))


def scores(rows: DataFrame, by: list[str], label: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score, area under the curve (by ranks, ties shared) and share of the larger class.

    Rows are counted by probability first. Ranks are running counts within BINS parts of the range of p, and from part to
    part over one row for each: a group of any size is ranked by many tasks.
    """
    n, pos, prob = F.col("_n"), F.col("_pos"), F.col(p)
    ties = rows.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    ties = ties.withColumn("_bin", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), prob)) * BINS))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ties.groupBy(*by, "_bin").agg(F.sum("_n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    inside = Window.partitionBy(*by, "_bin").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(bins, [*by, "_bin"])
    rank = F.col("_before") + F.col("_own") + (n + 1) / 2
    hit, total, positives = prob >= 0.5, F.sum("_n"), F.sum("_pos")
    out = ranked.groupBy(*by).agg(
        total.alias("n"), (F.sum(F.when(hit, pos).otherwise(n - pos)) / total).alias("accuracy"), F.try_divide(F.sum(F.when(hit, pos)), F.sum(F.when(hit, n))).alias("precision"), F.try_divide(F.coalesce(F.sum(F.when(hit, pos)), F.lit(0)), positives).alias("recall"),
        (F.sum(pos * F.pow(prob - 1, 2) + (n - pos) * F.pow(prob, 2)) / total).alias("brier"), F.try_divide(F.sum(pos * rank) - positives * (positives + 1) / 2, positives * (total - positives)).alias("auc"), (F.greatest(positives, total - positives) / total).alias("baseline"),
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def thresholds(rows: DataFrame, label: str = "y", p: str = "p") -> DataFrame:
    """Signals, precision and recall at thresholds from 0.50 to 0.90."""
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(round(0.5 + 0.05 * k, 2)) for k in range(9)])))
    hit, y = (F.col(p) >= F.col("threshold")).cast("int"), F.col(label)
    return each.groupBy("threshold").agg(F.sum(hit).alias("signals"), F.try_divide(F.sum(hit * y), F.sum(hit)).alias("precision"), F.try_divide(F.sum(hit * y), F.sum(y)).alias("recall"))


def regression_scores(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction"))


def suite(rows: DataFrame, features: list[str], test_size: float = 0.2) -> DataFrame:
    """Every model fitted to the first rows and scored on the last, best first: by area, then Brier score, then F1. rows: ticker, date, features, y."""
    rows = chronological(rows.dropna(subset=[*features, "y"]), test_size)
    out = None
    for name, model in models().items():
        fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model]).fit(rows.filter("train"))
        p = fitted.transform(rows.filter("not train")).select(F.lit(name).alias("model"), "y", vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("auc"), "brier", F.desc_nulls_last("f1")))  # one row per model
    return scores(out, ["model"]).withColumns({"rank": rank, "reliable": F.coalesce(F.col("auc") >= 0.52, F.lit(False))})


def walk_forward(rows: DataFrame, features: list[str], first: float = 0.6, step: int = 30, ridge: float = 1e-3) -> DataFrame:
    """(ticker, date, fold, y, p): a logistic model refitted to all rows before each fold of `step` rows, tickers side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        x, y = pdf[features].to_numpy(float), pdf["y"].to_numpy(float)
        out = []
        for fold, at in enumerate(range(int(len(pdf) * first), len(pdf), step)):
            if at < 2:
                continue
            mean, sd = x[:at].mean(0), x[:at].std(0)
            z = np.column_stack([np.ones(len(pdf)), (x - mean) / np.where(sd > 0, sd, 1)])
            beta = np.zeros(z.shape[1])
            for _ in range(15):  # Newton's method
                p = 1 / (1 + np.exp(-np.clip(z[:at] @ beta, -30, 30)))
                h = (z[:at] * (p * (1 - p))[:, None]).T @ z[:at] + ridge * at * np.eye(len(beta))
                beta += np.linalg.solve(h, z[:at].T @ (y[:at] - p) - ridge * at * beta)
            part = slice(at, at + step)
            out.append(pd.DataFrame({"ticker": pdf["ticker"][part], "date": pdf["date"][part], "fold": fold, "y": pdf["y"][part], "p": 1 / (1 + np.exp(-np.clip(z[part] @ beta, -30, 30)))}))
        return pd.concat(out) if out else pd.DataFrame({"ticker": [], "date": [], "fold": [], "y": [], "p": []})

    schema = "ticker string, date date, fold int, y int, p double"
    return rows.dropna(subset=[*features, "y"]).select("ticker", "date", *features, F.col("y").cast("int")).groupBy("ticker").applyInPandas(run, schema)


def cluster_regimes(rows: DataFrame, features: list[str], k: int = 4, mixture: bool = False, seed: int = 42) -> DataFrame:
    """rows with state, and for a Gaussian mixture the probability of it. Features are standardized over the whole history."""
    rows = rows.dropna(subset=features)
    model = GaussianMixture(featuresCol="x", predictionCol="state", k=k, seed=seed) if mixture else KMeans(featuresCol="x", predictionCol="state", k=k, seed=seed)
    out = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model]).fit(rows).transform(rows)
    return (out.withColumn("state_probability", F.array_max(vector_to_array("probability"))).drop("probability") if mixture else out).drop("raw", "x")


def label_regimes(rows: DataFrame) -> DataFrame:
    """rows (state, r, vol, dd) with a label for their state, by its means against the medians of all states."""
    each = rows.groupBy("state").agg(F.avg("r").alias("mr"), F.avg("vol").alias("mv"), F.avg("dd").alias("md"))
    every = Window.partitionBy(F.lit(0))  # one row per state
    each = each.withColumns({f"{c}_": F.median(c).over(every) for c in ("mr", "mv", "md")})
    label = F.when((F.col("md") < F.col("md_")) & (F.col("mv") > F.col("mv_")) & (F.col("mr") < 0), "Stress / Selloff").when((F.col("mr") < 0) & (F.col("mv") > F.col("mv_")), "High-Vol Bearish").when((F.col("mr") > 0) & (F.col("mv") <= F.col("mv_")), "Low-Vol Bullish").when((F.col("mr") > F.col("mr_")) & (F.col("md") < F.col("md_")), "Recovery").otherwise("Sideways / Choppy")
    return rows.join(F.broadcast(each.select("state", label.alias("regime"))), "state")


def regimes(rows: DataFrame, features: list[str], model: str = "hmm", k: int = 4, *, least_rows: int = 60, size: int = SIZE, days: int = DAYS) -> DataFrame:
    """(ticker, date, state, state_probability, model) by hmm, gmm or kmeans.

    A hidden Markov model is fitted to each ticker of at least least_rows rows; the others, and all of them with gmm, get a
    Gaussian mixture over all tickers, whose rows say so. k-means has no probabilities.
    """
    kept = ["ticker", "date", "state", "state_probability", "model"]
    rows = rows.dropna(subset=features)
    if model == "kmeans":
        out = cluster_regimes(rows, features, k).withColumn("state_probability", F.lit(None).cast("double"))
        return out.withColumn("model", F.lit("kmeans")).select(kept)
    if model not in ("hmm", "gmm"):
        raise ValueError(f"unknown model {model!r}")
    mixed = cluster_regimes(rows, features, k, mixture=True).withColumn("model", F.lit("gmm")).select(kept)
    if model == "gmm":
        return mixed
    found = detected(rows, features, k, least_rows=least_rows, size=size, days=days).withColumn("model", F.lit("hmm")).select(kept)
    few = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least_rows).select("ticker")
    return found.unionByName(mixed.join(few, "ticker", "left_semi"))
