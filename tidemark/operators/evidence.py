"""Evidence from outside series: parsing, quality checks, coverage and confidence, profiles, runs and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import market

# The date formats that are tried, in order.
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyyMMdd")
# Days after which an observation of a frequency counts as stale, and of any other.
HORIZONS, OTHER_HORIZON = (("monthly", 120), ("quarterly", 240), ("annual", 730)), 365
# Indicator, bound, whether below or from it on, and severity of country alerts.
ALERTS = (
    ("real_gdp_growth", "growth-contraction", "below", 0.0, "high"),
    ("industrial_production_growth", "industrial-contraction", "below", 0.0, "medium"),
    ("consumer_inflation", "high-inflation", "from", 6.0, "medium"),
)
# Kinds of instruments that a search returns.
INSTRUMENTS = ("EQUITY", "ETF", "INDEX")
ITEM = (
    "title string, publisher string, link string, providerPublishTime long, summary string, relatedTickers array<string>, content struct<title:string,summary:string,description:string,pubDate:string,"
    "displayTime:string,relatedTickers:array<string>,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>"
)


def parsed_date(text: Column) -> Column:
    """The date that the first ten characters of a text give in the first format that fits; null if none does."""
    head = F.substring(F.trim(text), 1, 10)
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DATE_FORMATS])


def number(text: Column) -> Column:
    """A number, or null for what stands for none."""
    return F.trim(text).try_cast("double")


def quality_checks(points: DataFrame, key: str, order: str, day: Column) -> DataFrame:
    """(key, check, status) of series (key, order, date, value): values finite, dates rising in the given order, none after a day."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rising = F.coalesce(F.col("date") > F.lag("date").over(Window.partitionBy(key).orderBy(order)), F.lit(True))
    rows = points.withColumn("_rising", rising)
    status = lambda c: F.when(c, "PASS").otherwise("FAIL")
    s = rows.groupBy(key).agg(F.bool_and(finite).alias("a"), F.bool_and("_rising").alias("b"), F.coalesce(F.max("date") <= day, F.lit(True)).alias("c"))
    names = (("non_empty_finite_values", "a"), ("unique_monotonic_dates", "b"), ("no_future_observations", "c"))
    return s.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("check"), status(F.col(c)).alias("status")) for n, c in names])))


def parsed_items(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with title, publisher, url, published, summary and related of a news item, from either of two shapes of JSON; items without
    a title are left out."""
    i = F.from_json(payload, ITEM)
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    rows = rows.withColumn("_i", i)
    i, c = F.col("_i"), F.col("_i.content")
    new = c.isNotNull()
    shape = lambda a, b: F.when(new, a).otherwise(b)
    old_time = F.date_format(F.timestamp_seconds(i["providerPublishTime"]), "yyyy-MM-dd HH:mm")
    related = F.coalesce(shape(F.coalesce(c["relatedTickers"], i["relatedTickers"]), i["relatedTickers"]), F.array().cast("array<string>"))
    return rows.withColumns({
        "title": shape(c["title"], i["title"]), "publisher": F.coalesce(some(shape(c["provider"]["displayName"], i["publisher"])), F.lit("—")),
        "url": F.coalesce(shape(some(c["canonicalUrl"]["url"], c["clickThroughUrl"]["url"]), i["link"]), F.lit("")),
        "published": F.coalesce(F.replace(F.substring(shape(some(c["pubDate"], c["displayTime"]), old_time), 1, 16), F.lit("T"), F.lit(" ")), F.lit("")),
        "summary": F.coalesce(shape(some(c["summary"], c["description"]), i["summary"]), F.lit("")),
        "related": F.transform(F.filter(related, lambda t: F.coalesce(t, F.lit("")) != ""), F.upper),
    }).filter(F.coalesce("title", F.lit("")) != "").drop("_i")


def ticker_map(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, cik, title) of JSON maps of objects; ciks are filled up to ten digits."""
    each = rows.select(F.explode(F.from_json(payload, "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("k", "v"))
    return each.filter("v.ticker is not null").select(F.upper("v.ticker").alias("ticker"), F.lpad("v.cik_str", 10, "0").alias("cik"), F.col("v.title").alias("title"))


def trade_totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of records: how many there are and the sum of their values, which are texts; null if none is a number."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"), F.round(F.sum(number(F.col("value"))), 2).alias("primary_value"))


def rollup(products: DataFrame, key: str, expected: Column | str = "expected") -> DataFrame:
    """AVAILABLE, PARTIAL or UNAVAILABLE by how many of a key's products are there; products: key, ok, expected."""
    out = products.groupBy(key).agg(F.count_if("ok").alias("there"), F.max(expected).alias("expected"))
    return out.withColumn("status", F.when(F.col("there") >= F.col("expected"), "AVAILABLE").when(F.col("there") > 0, "PARTIAL").otherwise("UNAVAILABLE"))


def horizon(frequency: Column) -> Column:
    out = F.when(frequency == HORIZONS[0][0], HORIZONS[0][1])
    for name, days in HORIZONS[1:]:
        out = out.when(frequency == name, days)
    return out.otherwise(OTHER_HORIZON)


def freshness(observed: Column, day: Column, days: Column) -> Column:
    age = F.greatest(F.lit(0), F.date_diff(day, observed))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - age / days), F.lit(0.0))


def confidence(series: DataFrame, key: str, day: Column, weights=(0.6, 0.2, 0.2), all_sources: bool = False) -> DataFrame:
    """Per key, of series (key, ok, cached, observed, frequency): status, coverage, cached ones, mean freshness, and a score of 0 to 100
    from the shares that are there, that are live, and that are fresh. all_sources: missing series count as not fresh."""
    ok = F.col("ok")
    fresh = F.when(ok, freshness(F.col("observed"), day, horizon(F.col("frequency"))))
    s = series.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), F.count_if(ok).alias("there"), F.count_if(ok & F.col("cached")).alias("cached"),
                                F.coalesce(F.avg(F.coalesce(fresh, F.lit(0.0)) if all_sources else fresh), F.lit(0.0)).alias("_f"))
    n = F.col("expected")
    score = 100 * (weights[0] * F.col("there") / n + weights[1] * (F.col("there") - F.col("cached")) / n + weights[2] * F.col("_f"))
    status = F.when(F.col("there") == n, "healthy").when(F.col("there") > 0, "degraded").otherwise("unavailable")
    return s.select(key, status.alias("status"), "there", "expected", "cached", F.bround("_f", 3).alias("freshness"), F.bround(F.round(score, 9)).cast("long").alias("score"))


def in_order(series: DataFrame, key: str, definitions: list[str]) -> DataFrame:
    """series that are there, with their place in the order of definitions; unknown ones come last, by id."""
    place = F.array_position(F.array(*map(F.lit, definitions)), F.col("id"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(place > 0, place).otherwise(1000), "id"))
    return series.filter("ok").withColumn("place", rank)


def alerts(latest: DataFrame) -> DataFrame:
    """(country, type, severity, value) of the latest values (country, id, value) that cross a bound."""
    v, i = F.col("value"), F.col("id")
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), ((i == n) & (v < b if side == "below" else v >= b)).alias("hit")) for n, t, side, b, s in ALERTS])
    return latest.select("country", "value", F.inline(rows)).filter("hit").select("country", "type", "severity", "value")


def profiles(tickers: DataFrame, registered: DataFrame) -> DataFrame:
    """ticker, company, country_code and industry: registered ones, else the ticker itself, its country by the ending, unclassified."""
    country = F.when(F.col("ticker").endswith(".NS") | F.col("ticker").endswith(".BO"), "IND").otherwise("USA")
    both = tickers.join(registered.select("ticker", F.col("company").alias("_c"), F.col("country_code").alias("_k"), F.col("industry").alias("_i")), "ticker", "left")
    return both.select(*tickers.columns, F.coalesce("_c", "ticker").alias("company"), F.coalesce("_k", country).alias("country_code"), F.coalesce("_i", F.lit("Unclassified")).alias("industry"))


def found_assets(quotes: DataFrame, which: str = "ALL", limit: int = 12) -> DataFrame:
    """The first `limit` different symbols of each query (query, position, symbol, exchange, name, kind) that are traded in a market."""
    symbol, exchange, kind = (F.upper(F.coalesce(F.col(c), F.lit(""))) for c in ("symbol", "exchange", "kind"))
    rows = quotes.withColumns({"symbol": symbol, "exchange": exchange, "kind": kind}).withColumn("market", market(F.col("exchange"), F.col("symbol")))
    rows = rows.filter((F.col("symbol") != "") & F.col("market").isNotNull() & F.col("kind").isin("", *INSTRUMENTS))
    rows = rows if which == "ALL" else rows.filter(F.col("market") == which)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query", "symbol").orderBy("position"))).filter("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("position"))).filter(F.col("rank") <= limit)
    place = F.when(F.col("exchange") != "", F.col("exchange")).when(F.col("symbol").endswith(".NS"), "NSE").when(F.col("symbol").endswith(".BO"), "BSE").otherwise("US")
    return ranked.select("query", "rank", "symbol", F.coalesce("name", "symbol").alias("name"), place.alias("exchange"), "market", F.when(F.col("kind") == "", "EQUITY").otherwise(F.col("kind")).alias("kind"))


def live_or_stored(wanted: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of wanted symbols (place, ticker): live ones (ticker, price, change), else stored ones, in the order wanted, with `live`."""
    rest = stored.join(live.select("ticker").distinct(), "ticker", "left_anti")
    rows = live.withColumn("live", F.lit(True)).unionByName(rest.withColumn("live", F.lit(False)))
    first = wanted.groupBy("ticker").agg(F.min("place").alias("place"))
    return first.join(rows, "ticker").select("place", "ticker", "price", "change", "live")


def recorded(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The audit of runs with new ones added, numbered on after the last of their pipeline; errors are cut at 500 characters."""
    last = runs.groupBy("pipeline").agg(F.max("run").alias("_last"))
    n = F.row_number().over(Window.partitionBy("pipeline").orderBy("started", "status"))
    added = new.join(last, "pipeline", "left").withColumn("run", (F.coalesce("_last", F.lit(0)) + n).cast("long"))
    added = added.withColumns({"received": F.coalesce("received", F.lit(0).cast("long")), "error": F.substring("error", 1, 500)})
    return runs.unionByName(added.select(*runs.columns))
