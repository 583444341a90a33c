"""Queries of evidence, names, searches and audits."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import evidence as E
from tidemark.plans.sql import WEEKLY, out
from tidemark.sources.bars import table, weekly_bars

DAY = datetime.date(2024, 1, 20)
TICKERS = tuple(t for t, _ in N.NAMES) + ("XYZ", "tatasteel.ns", "ABC.BO")
INDICATORS = ("real_gdp_growth", "consumer_inflation", "industrial_production_growth")
REGISTERED = (("AAPL", "Apple Inc.", "USA", "Devices"), ("TCS.NS", "Tata Consultancy", "IND", "Services"))


def _one_of(words, n):
    return F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))


def dates(spark, d):
    """Order days written in four formats, or in none."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    written = [F.date_format(day, f) for f in E.DATE_FORMATS]
    text = F.when(k % 6 == 0, written[0]).when(k % 6 == 1, written[1]).when(k % 6 == 2, written[2]).when(k % 6 == 3, written[3]).when(k % 6 == 4, "no date")
    return table(spark, d, "orders").select("o_orderkey", E.parsed_date(text).alias("day"))


def quality(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("date"), "value")
    return E.quality_checks(rows, "user_id", "event_id", F.lit(DAY))


def _items(spark, d):
    """Parts as news items in two shapes."""
    k = F.col("p_partkey")
    new = F.to_json(F.struct(F.struct(F.when(k % 5 > 0, F.col("p_name")).alias("title"), F.col("p_type").alias("description"), F.lit("2024-01-15T10:30:00Z").alias("pubDate"), F.array(F.lit("aapl"), F.lower("p_brand")).alias("relatedTickers"),
                                      F.struct(F.when(k % 4 > 0, F.col("p_brand")).alias("displayName")).alias("provider"), F.struct(F.concat(F.lit("http://x/"), k).alias("url")).alias("clickThroughUrl")).alias("content")))
    old = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.when(k % 3 > 0, F.concat(F.lit("http://y/"), k)).alias("link"), (F.lit(1_700_000_000) + k * 60).alias("providerPublishTime"), F.col("p_type").alias("summary")))
    return table(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, new).otherwise(old).alias("payload"))


def items(spark, d):
    return E.parsed_items(_items(spark, d)).select("p_partkey", "title", "publisher", "url", "published", "summary", F.concat_ws(",", "related").alias("related"))


def ticker_map(spark, d):
    """One JSON map per region, of its nations."""
    n = table(spark, d, "nation")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_nationkey").cast("string").alias("cik_str"), F.lower("n_name").alias("ticker"), F.initcap("n_name").alias("title")).alias("value"))
    maps = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return E.ticker_map(maps)


def trade(spark, d):
    value = F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("flow"), value.alias("value"))
    return E.trade_totals(rows, ["period", "flow"])


def status(spark, d):
    """Orders as products of their customer and year, there if they are filled; one to three are expected, by customer."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("of"), (F.col("o_orderstatus") == "F").alias("ok"),
        (1 + F.col("o_custkey") % 3).cast("long").alias("expected"),
    )
    return E.rollup(rows, "of")


def _series(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("country"), F.when(k % 4 == 0, F.concat(F.lit("series_"), k)).otherwise(_one_of(INDICATORS, k)).alias("id"), (F.col("s_acctbal") > 0).alias("ok"), (k % 3 == 0).alias("cached"),
        F.date_sub(F.lit(DAY), ((k * 37) % 900).cast("int")).alias("observed"), _one_of(("monthly", "quarterly", "annual", "daily"), k).alias("frequency"), (F.col("s_acctbal") / 1000).alias("value"), "s_suppkey",
    )


def pulse(spark, d):
    return out(E.confidence(_series(spark, d), "country", F.lit(DAY)))


def overview(spark, d):
    return out(E.confidence(_series(spark, d), "country", F.lit(DAY), (0.5, 0.25, 0.25), all_sources=True))


def ordered(spark, d):
    rows = _series(spark, d).groupBy("country", "id").agg(F.bool_or("ok").alias("ok"))
    return E.in_order(rows, "country", list(INDICATORS)).select("country", "id", "place")


def alerts(spark, d):
    rows = _series(spark, d)
    latest = rows.filter("ok or value < -0.5").groupBy("country", "id").agg(F.max_by("value", F.struct("observed", "s_suppkey")).alias("value"))
    return out(E.alerts(latest))


def _tickers(spark, d):
    """Customers with a ticker each."""
    return table(spark, d, "customer").select("c_custkey", _one_of(TICKERS, F.col("c_custkey")).alias("ticker"))


def profiles(spark, d):
    registered = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ticker", "company", "country_code", "industry"), r)]) for r in REGISTERED])))
    return E.profiles(_tickers(spark, d), F.broadcast(registered))  # as many rows as REGISTERED


def display_names(spark, d):
    t = F.col("ticker")
    return _tickers(spark, d).select("c_custkey", "ticker", N.display_name(t).alias("name"), N.default_benchmark(t).alias("benchmark"))


def assets(spark, d):
    """Orders of a customer as what a search returned, in order."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), k.alias("position"), _one_of(("aapl", "TCS.NS", "abc.bo", "", "msft", "xyz"), k).alias("symbol"), _one_of(("NMS", "NSI", "", "LSE", "nyq"), k).alias("exchange"),
                                           F.when(k % 7 > 0, F.col("o_orderpriority")).alias("name"), _one_of(("equity", "etf", "FUTURE", ""), k).alias("kind"))
    return E.found_assets(rows, "ALL", 3)


def tape(spark, d):
    """Last closes of the weekly bars, two of them replaced by live prices, as wanted."""
    bars = weekly_bars(spark, d)
    stored = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"), (F.max_by("close", "date") / F.max_by("open", "date") - 1).alias("change"))
    live = stored.filter("ticker in ('A', 'R')").select("ticker", (F.col("price") + 1).alias("price"), F.lit(0.0).alias("change"))
    wanted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("ticker")) for i, t in enumerate(("R", "N", "Q", "A", "R"))])))
    return out(E.live_or_stored(F.broadcast(wanted), live, stored))  # five rows


def recorded(spark, d):
    """Events as runs: purchases are stored, clicks come new."""
    e = table(spark, d, "events")
    runs = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("pipeline"), F.lit("ok").alias("status"), F.col("ts").alias("started"), F.col("event_id").alias("received"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("run"))
    new = e.filter("event_type = 'click'").select(F.col("user_id").alias("pipeline"), F.concat(F.lit("run "), "event_id").alias("status"), F.col("ts").alias("started"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("received"), F.repeat(F.lit("e"), 600).alias("error"))
    return E.recorded(runs, new).select("pipeline", "run", "status", "received", F.coalesce(F.length("error"), F.lit(0)).alias("error_length"))


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_of = lambda words, n: f"list_extract({_list(words)}, 1 + {n} % {len(words)})"
_TICKERS = f"tk AS (SELECT c_custkey, {_of(TICKERS, 'c_custkey')} AS ticker FROM customer)"
_SERIES = f"""se AS (SELECT s_nationkey AS country, s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'series_' || s_suppkey ELSE {_of(INDICATORS, 's_suppkey')} END AS id, s_acctbal > 0 AS ok, s_suppkey % 3 = 0 AS cached,
  DATE '{DAY}' - CAST((s_suppkey * 37) % 900 AS INTEGER) AS observed, {_of(('monthly', 'quarterly', 'annual', 'daily'), 's_suppkey')} AS frequency, s_acctbal / 1000 AS value FROM supplier)"""
_FRESH = f"greatest(0, 1 - greatest(0, date_diff('day', observed, DATE '{DAY}')) / CASE frequency WHEN 'monthly' THEN 120 WHEN 'quarterly' THEN 240 WHEN 'annual' THEN 730 ELSE 365 END)"


def _confidence(a: float, b: float, c: float, every: bool) -> str:
    fresh = f"CASE WHEN ok THEN {_FRESH} {'ELSE 0 ' if every else ''}END"
    return f"""WITH {_SERIES}, g AS (SELECT country, count(*) AS expected, count(*) FILTER (ok) AS there, count(*) FILTER (ok AND cached) AS cached, coalesce(avg({fresh}), 0) AS f FROM se GROUP BY country)
      SELECT country, CASE WHEN there = expected THEN 'healthy' WHEN there > 0 THEN 'degraded' ELSE 'unavailable' END AS status, there, expected, cached, round_even(f, 3)::DOUBLE AS freshness,
      CAST(round_even(round(100 * ({a} * there / expected + {b} * (there - cached) / expected + {c} * f), 9), 0) AS BIGINT) AS score FROM g"""


QUERIES = {
    "records_dates": dates, "evidence_quality": quality, "records_items": items, "records_ticker_map": ticker_map, "records_trade": trade, "evidence_status": status, "evidence_pulse": pulse,
    "evidence_overview": overview, "evidence_ordered": ordered, "evidence_alerts": alerts, "records_profiles": profiles, "records_names": display_names, "search_assets": assets,
    "records_tape": tape, "records_runs": recorded,
}

ORACLE_SQL = {
    "records_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "evidence_quality": f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, value, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
        g AS (SELECT user_id, bool_and(value IS NOT NULL AND isfinite(value)) AS a, bool_and(coalesce(date > before, true)) AS b, max(date) <= DATE '{DAY}' AS c FROM e GROUP BY user_id)
        SELECT user_id, n AS "check", CASE WHEN CASE n WHEN 'non_empty_finite_values' THEN a WHEN 'unique_monotonic_dates' THEN b ELSE c END THEN 'PASS' ELSE 'FAIL' END AS status
        FROM g, (VALUES ('non_empty_finite_values'), ('unique_monotonic_dates'), ('no_future_observations')) t(n)""",
    "records_items": """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN '—' ELSE p_brand END AS publisher,
        CASE WHEN p_partkey % 2 = 0 THEN 'http://x/' || p_partkey WHEN p_partkey % 3 > 0 THEN 'http://y/' || p_partkey ELSE '' END AS url,
        CASE WHEN p_partkey % 2 = 0 THEN '2024-01-15 10:30' ELSE strftime(make_timestamp((1700000000 + p_partkey * 60) * 1000000), '%Y-%m-%d %H:%M') END AS published, p_type AS summary,
        CASE WHEN p_partkey % 2 = 0 THEN 'AAPL,' || upper(p_brand) ELSE '' END AS related FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 5 > 0""",
    "records_ticker_map": "SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM nation",
    "records_trade": "SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority AS flow, count(*) AS record_count, round(sum(o_totalprice) FILTER (o_orderkey % 5 <> 0), 2) AS primary_value FROM orders GROUP BY 1, 2",
    "evidence_status": """WITH g AS (SELECT o_custkey || '-' || year(o_orderdate) AS "of", count(*) FILTER (o_orderstatus = 'F') AS there,
          CAST(any_value(1 + o_custkey % 3) AS BIGINT) AS expected FROM orders GROUP BY 1)
        SELECT *, CASE WHEN there >= expected THEN 'AVAILABLE' WHEN there > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status FROM g""",
    "evidence_pulse": _confidence(0.6, 0.2, 0.2, False),
    "evidence_overview": _confidence(0.5, 0.25, 0.25, True),
    "evidence_ordered": f"""WITH {_SERIES}, g AS (SELECT country, id, bool_or(ok) AS ok FROM se GROUP BY 1, 2)
        SELECT country, id, CAST(row_number() OVER (PARTITION BY country ORDER BY coalesce(list_position({_list(INDICATORS)}, id), 1000), id) AS INTEGER) AS place FROM g WHERE ok""",
    "evidence_alerts": f"""WITH {_SERIES}, l AS (SELECT country, id, arg_max(value, (observed, s_suppkey)) AS value FROM se WHERE ok OR value < -0.5 GROUP BY 1, 2)
        SELECT country, CASE id WHEN 'real_gdp_growth' THEN 'growth-contraction' WHEN 'consumer_inflation' THEN 'high-inflation' ELSE 'industrial-contraction' END AS type, CASE id WHEN 'real_gdp_growth' THEN 'high' ELSE 'medium' END AS severity, round(value, 6) AS value
        FROM l WHERE (id IN ('real_gdp_growth', 'industrial_production_growth') AND value < 0) OR (id = 'consumer_inflation' AND value >= 6)""",
    "records_profiles": f"""WITH {_TICKERS}, r(ticker, c, k, i) AS (VALUES {", ".join(str(r) for r in REGISTERED)})
        SELECT c_custkey, tk.ticker, coalesce(c, tk.ticker) AS company, coalesce(k, CASE WHEN tk.ticker LIKE '%.NS' OR tk.ticker LIKE '%.BO' THEN 'IND' ELSE 'USA' END) AS country_code, coalesce(i, 'Unclassified') AS industry FROM tk LEFT JOIN r ON r.ticker = tk.ticker""",
    "records_names": f"""WITH {_TICKERS}, n(ticker, name) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in N.NAMES)})
        SELECT c_custkey, tk.ticker, coalesce(name, tk.ticker) AS name, CASE WHEN upper(tk.ticker) LIKE '%.NS' THEN '{N.INDIAN_BENCHMARK}' ELSE '{N.OTHER_BENCHMARK}' END AS benchmark FROM tk LEFT JOIN n ON n.ticker = tk.ticker""",
    "search_assets": f"""WITH q AS (SELECT o_custkey AS query, o_orderkey AS position, upper({_of(('aapl', 'TCS.NS', 'abc.bo', '', 'msft', 'xyz'), 'o_orderkey')}) AS symbol, upper({_of(('NMS', 'NSI', '', 'LSE', 'nyq'), 'o_orderkey')}) AS exchange,
          CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS name, upper({_of(('equity', 'etf', 'FUTURE', ''), 'o_orderkey')}) AS kind FROM orders),
        m AS (SELECT *, CASE WHEN symbol LIKE '%.NS' OR symbol LIKE '%.BO' OR exchange IN {N.INDIAN_EXCHANGES} THEN 'INDIA' WHEN exchange IN {N.US_EXCHANGES} OR exchange = '' THEN 'US' END AS market FROM q),
        f AS (SELECT *, row_number() OVER (PARTITION BY query, symbol ORDER BY position) AS n FROM m WHERE symbol <> '' AND market IS NOT NULL AND kind IN ('', 'EQUITY', 'ETF', 'INDEX')),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS rank FROM f WHERE n = 1)
        SELECT query, CAST(rank AS INTEGER) AS rank, symbol, coalesce(name, symbol) AS name, CASE WHEN exchange <> '' THEN exchange WHEN symbol LIKE '%.NS' THEN 'NSE' WHEN symbol LIKE '%.BO' THEN 'BSE' ELSE 'US' END AS exchange, market,
        CASE WHEN kind = '' THEN 'EQUITY' ELSE kind END AS kind FROM r WHERE rank <= 3""",
    "records_tape": f"""WITH {WEEKLY}, s AS (SELECT ticker, arg_max(close, date) AS price, arg_max(close, date) / arg_max(open, date) - 1 AS change FROM bars GROUP BY 1)
        SELECT place, s.ticker, round(price + CASE WHEN s.ticker = 'N' THEN 0 ELSE 1 END, 6) AS price, CASE WHEN s.ticker = 'N' THEN round(change, 6) ELSE 0.0::DOUBLE END AS change, s.ticker <> 'N' AS live FROM s JOIN (VALUES (0, 'R'), (1, 'N'), (3, 'A')) w(place, ticker) ON w.ticker = s.ticker""",
    "records_runs": """WITH o AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, 'run ' || event_id) AS rn FROM events e WHERE event_type = 'click')
        SELECT user_id AS pipeline, event_id AS run, 'ok' AS status, event_id AS received, 0 AS error_length FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT n.user_id, coalesce(last, 0) + rn, 'run ' || event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END, 500 FROM n LEFT JOIN o ON o.user_id = n.user_id""",
}
