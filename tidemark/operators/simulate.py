"""Simulated price paths. Draws come from counters, not from partitions: the same seed gives the same paths on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import normal_draw
from tidemark.functions.windows import ratio


def paths(spark: SparkSession, start: float, mu: float, sigma: float, years: float, steps: int = 252, n: int = 10_000, seed: int = 42) -> DataFrame:
    """(sim, step, price) of geometric Brownian motion; simulations are spread over tasks, each path is summed in its own."""
    dt = years / steps
    rows = spark.range(n).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    rows = rows.withColumn("z", F.when(F.col("step") > 0, (mu - sigma * sigma / 2) * dt + sigma * math.sqrt(dt) * normal_draw(F.col("sim"), F.col("step"), seed=seed)).otherwise(0.0))
    return rows.select("sim", "step", (start * F.exp(F.sum("z").over(Window.partitionBy("sim").orderBy("step")))).alias("price"))


def summary(rows: DataFrame, start: float) -> DataFrame:
    last = rows.groupBy("sim").agg(F.max_by("price", "step").alias("p"))
    r = F.col("p") / start - 1
    return last.agg(F.avg("p").alias("mean"), F.median("p").alias("median"), F.min("p").alias("low"), F.max("p").alias("high"), F.avg((r < 0).cast("double")).alias("loss_probability"), F.greatest(F.lit(0.0), -F.percentile(r, 0.05)).alias("var"))


def bands(rows: DataFrame, shares=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles of the price at each step."""
    return rows.groupBy("step").agg(*[F.percentile("price", s).alias(f"p{round(100 * s)}") for s in shares])


def densities(rows: DataFrame, n_time: int = 30, n_price: int = 60, clip=(0.01, 0.99)) -> DataFrame:
    """(step, bin, low, density): histograms of the price at evenly spaced steps, over the middle of all prices there."""
    steps = rows.agg(F.max("step")).first()[0] or 0
    chosen = sorted({round(1 + k * (steps - 1) / max(1, n_time - 1)) for k in range(n_time)})
    rows = rows.filter(F.col("step").isin(chosen))
    ends = rows.agg(*[F.percentile("price", c).alias(n) for c, n in zip(clip, ("lo", "hi"))])
    width = (F.col("hi") - F.col("lo")) / n_price
    binned = rows.join(F.broadcast(ends)).filter(F.col("price").between(F.col("lo"), F.col("hi"))).withColumns({"width": width, "bin": F.least(F.lit(n_price - 1), F.floor((F.col("price") - F.col("lo")) / width)).cast("int")})
    each = Window.partitionBy("step")
    return binned.groupBy("step", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n")).select("step", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("n") / (F.sum("n").over(each) * F.col("width"))).alias("density"))


def shocked(pairs: DataFrame, shock: float, horizon: int = 21, n: int = 4000, seed: int = 42, least: int = 30) -> DataFrame:
    """(scenario, mean, median, p5, p95, prob_loss, beta, expected_move) of a return over `horizon` rows; no rows under `least` pairs.

    pairs: f, d, the returns of an asset and of what it depends on. Baseline draws have f's mean and deviation; in the shocked
    scenario d moves by `shock` in equal steps, f follows by its slope, and the residual is drawn.
    """
    f, d = F.col("f"), F.col("d")
    beta = F.coalesce(F.try_divide(F.covar_samp(f, d), F.var_samp(d)), F.lit(0.0))
    fit = pairs.dropna().agg(F.count(F.lit(1)).alias("pairs"), beta.alias("beta"), F.avg(f).alias("mf"), F.avg(d).alias("md"), F.stddev_samp(f).alias("sf"), F.var_samp(f).alias("vf"), F.covar_samp(f, d).alias("c"))
    # the residual's variance follows from the sums: no second pass
    fit = fit.filter(F.col("pairs") >= least).withColumns({"alpha": F.col("mf") - F.col("beta") * F.col("md"), "rs": F.sqrt(F.greatest(F.lit(0.0), F.col("vf") - F.col("beta") * F.col("c")))})
    daily = (1 + shock) ** (1 / horizon) - 1
    draws = pairs.sparkSession.range(n).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    draws = draws.withColumns({"z0": normal_draw(F.col("sim"), F.col("step"), seed=seed), "z1": normal_draw(F.col("sim"), F.col("step"), seed=seed + 1)}).join(F.broadcast(fit))  # one row
    base, moved = F.product(1 + F.col("mf") + F.col("sf") * F.col("z0")) - 1, F.product(1 + F.col("alpha") + F.col("beta") * daily + F.col("rs") * F.col("z1")) - 1
    each = draws.groupBy("sim").agg(F.first("beta").alias("beta"), F.array(F.struct(F.lit("baseline").alias("scenario"), base.alias("r")), F.struct(F.lit("shocked").alias("scenario"), moved.alias("r"))).alias("x"))
    rows = each.select("beta", F.inline("x"))
    return rows.groupBy("scenario").agg(
        F.avg("r").alias("mean"), F.median("r").alias("median"), F.percentile("r", 0.05).alias("p5"), F.percentile("r", 0.95).alias("p95"),
        F.avg((F.col("r") < 0).cast("double")).alias("prob_loss"), F.first("beta").alias("beta"), (F.first("beta") * shock).alias("expected_move"),
    )


def loss_tail(rows: DataFrame, start: float, level: float = 0.95) -> DataFrame:
    """(var, cvar) of simulated returns: the loss at the quantile, and the mean of the losses from there on."""
    r = rows.groupBy("sim").agg(F.max_by("price", "step").alias("p")).select((F.col("p") / start - 1).alias("r"))
    q = r.agg(F.percentile("r", 1 - level).alias("q"))
    tail = r.join(F.broadcast(q)).filter(F.col("r") <= F.col("q"))  # one row
    return tail.agg(F.greatest(F.lit(0.0), -F.first("q")).alias("var"), F.greatest(F.lit(0.0), -F.avg("r")).alias("cvar"))


def option_price(spark: SparkSession, s: float, k: float, t: float, r: float, sigma: float, q: float = 0.0, call: bool = True, n: int = 100_000, seed: int = 7) -> DataFrame:
    """(price, stderr) of an option from n (1,000 to 500,000) final prices."""
    n = max(1000, min(int(n), 500_000))
    last = s * F.exp((r - q - 0.5 * sigma * sigma) * t + sigma * math.sqrt(t) * normal_draw(F.col("id"), seed=seed))
    pay = F.greatest(last - k if call else k - last, F.lit(0.0)) * math.exp(-r * t)
    return spark.range(n).agg(F.avg(pay).alias("price"), (F.stddev_samp(pay) / math.sqrt(n)).alias("stderr"))


def histogram(rows: DataFrame, start: float, bins: int = 40) -> DataFrame:
    """(bin, center, n) of simulated returns in equal bins from the least to the greatest, the last one closed."""
    r = rows.groupBy("sim").agg(F.max_by("price", "step").alias("p")).select((F.col("p") / start - 1).alias("r"))
    ends = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor(ratio(F.col("r") - F.col("lo"), width))).cast("int")
    return r.join(F.broadcast(ends)).groupBy(at.alias("bin"), (F.col("lo") + (at + 0.5) * width).alias("center")).agg(F.count(F.lit(1)).alias("n"))  # one row
