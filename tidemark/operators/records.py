"""Keyed records: fill-forward joins, latest of a key, vintages, licences, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_filled(rows: DataFrame, facts: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """rows left-joined to facts on keys and order; what a key has no fact for keeps its last one, and 0 before any."""
    out = rows.join(facts, [*keys, order], "left")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last fact of their key at or before their time: one union, one window, no range join."""
    both = rows.withColumns({"_fact": F.lit(None).cast(dict(facts.dtypes)[value]), "_own": F.lit(1)}).unionByName(facts.select(key, at, F.col(value).alias("_fact"), F.lit(0).alias("_own")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_fact", ignorenulls=True).over(w)).filter("_own = 1").drop("_fact", "_own")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def known_on(facts: DataFrame, day: Column, key: str) -> DataFrame:
    """Of facts with known_from and known_until, those known on a day: the last two observations of each key and their difference."""
    seen = facts.filter((F.col("known_from") <= day) & (F.col("known_until").isNull() | (F.col("known_until") > day)))
    w = Window.partitionBy(key).orderBy("date")
    rows = seen.withColumns({"previous": F.lag("value").over(w), "_n": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))})
    return rows.filter("_n = 1").select(key, "date", "value", "previous", (F.col("value") - F.col("previous")).alias("delta"))


def year_on_year(rows: DataFrame, key: str, order: str, value: str, season: int = 12) -> DataFrame:
    """Change against the value a season before, or else against the one before."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(value, season).over(w), F.lag(value).over(w))
    return rows.withColumn("change", F.try_divide(F.col(value), before) - 1)


def licences(wanted: DataFrame, registered: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """(dataset, status): NOT_REGISTERED, NOT_GRANTED, or the grant's own, where an active one may be PENDING or EXPIRED."""
    rows = wanted.join(registered.withColumn("_r", F.lit(True)), "dataset", "left").join(grants.withColumn("_g", F.lit(True)), "dataset", "left")
    status = F.upper("status")
    return rows.select("dataset", F.when(F.col("_r").isNull(), "NOT_REGISTERED").when(F.col("_g").isNull(), "NOT_GRANTED")
                       .when((status == "ACTIVE") & (F.col("starts_at") > at), "PENDING").when((status == "ACTIVE") & (F.col("ends_at") <= at), "EXPIRED").otherwise(status).alias("status"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and the stored ones whose key is not among them."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(*columns: Column | str) -> Column:
    """Content address of a record: sha256 of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def freshness(observed: Column, day: Column, horizon: int) -> Column:
    """1 for today's, falling to 0 over `horizon` days; 0 if unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.date_diff(day, observed) / horizon), F.lit(0.0))
