"""Queries of signals, fundamentals, books, labels and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import change, rounded
from tidemark.operators import filings as D
from tidemark.operators import learn as L
from tidemark.operators import records as K
from tidemark.operators import research as R
from tidemark.operators import text as T
from tidemark.plans import market
from tidemark.plans.sql import BLOCKS, OVER, WEEKLY
from tidemark.plans.sql import rounded as sql
from tidemark.sources.bars import table, weekly_bars
from tidemark.sources.news import NEWS, headlines

QUERY = "market risk growth"


def _out(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def signals(spark, d):
    """Each source's documents by a length score whose quality is judged per source."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    per = L.scores(docs, ["source"]).select("source", F.round("auc", 9).alias("auc"), F.round(F.col("accuracy") - F.col("baseline"), 9).alias("edge"))
    q = docs.join(per, "source").withColumn("quality", R.signal_quality(F.col("auc"), F.col("edge")))
    q = q.withColumns({"signal": R.signal(F.col("p"), F.col("quality")), "confidence": R.confidence(F.col("p"))})
    return q.select("doc_id", "quality", "signal", "confidence", R.adjusted(F.col("signal"), F.when(F.col("y") == 0, "Stress / Selloff").otherwise("Sideways / Choppy"), F.col("confidence")).alias("adjusted"))


def fundamentals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("concept"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("seq"))
    return _out(R.fundamentals(o))


def prices(spark, d):
    """Median, least and greatest price, distinct sizes and completeness of each part type."""
    p = table(spark, d, "part")
    return _out(p.groupBy("p_type").agg(F.median("p_retailprice").alias("median"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count_distinct("p_size").alias("sizes"), F.avg(F.col("p_retailprice").isNotNull().cast("double")).alias("completeness")))


def observations(spark, d):
    """JSON of each event read by a schema: the mean of its field by kind, with an alert over 50."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    out = e.groupBy("event_type").agg(F.avg("k").alias("mean"), F.max("k").alias("top"), F.count("k").alias("n"))
    return _out(out.withColumn("alert", F.coalesce(F.col("mean") > 50, F.lit(False))))


def series(spark, d):
    """Days of events as parallel arrays per kind, zipped back to rows."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    packed = e.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("date", "v"))).alias("r")).select("event_type", F.col("r.date").alias("dates"), F.col("r.v").alias("values"))
    each = packed.select("event_type", F.explode(F.arrays_zip("dates", "values")).alias("x"))
    return _out(each.select("event_type", F.col("x.dates").alias("date"), F.col("x.values").alias("value")).dropna())


def _book(spark, d):
    return R.book(table(spark, d, "customer").withColumn("mv", F.col("c_acctbal")), "c_mktsegment")


def book(spark, d):
    return _out(_book(spark, d))


def stress(spark, d):
    return _out(R.stressed(_book(spark, d).select("c_mktsegment", "net"), F.lit(1.2)))


def labels(spark, d):
    s = table(spark, d, "part")
    name = F.concat(F.col("p_name"), F.lit(", Co. Ltd"))
    return s.select("p_partkey", R.plain_label(name).alias("label"), R.slug(name).alias("slug"))


def health(spark, d):
    return R.health(table(spark, d, "events"), "user_id", "event_type", ["purchase", "signup", "click"])


def health_days(spark, d):
    """As health, of a user's days."""
    e = table(spark, d, "events").withColumn("user_day", F.concat_ws(" ", "user_id", F.to_date("ts")))
    return R.health(e, "user_day", "event_type", ["purchase", "signup", "click"])


def evidence(spark, d):
    s = market.licences(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("dataset"), "s_nationkey"), "dataset")
    return R.evidence(s, "s_nationkey")


def segments(spark, d):
    return _out(R.segments(headlines(spark, d).select("customer", "text"), "customer"))


def ewma(spark, d):
    return _out(R.ewma(weekly_bars(spark, d), **BLOCKS))


def ewm_deviation(spark, d):
    return _out(R.ewm_deviation(weekly_bars(spark, d), **BLOCKS))


def rolling_value_at_risk(spark, d):
    return _out(R.rolling_value_at_risk(weekly_bars(spark, d), **BLOCKS))


def quote(spark, d):
    return _out(R.quote(weekly_bars(spark, d)))


def snapshots(spark, d):
    return table(spark, d, "customer").select("c_custkey", K.fingerprint("c_custkey", "c_mktsegment").alias("snapshot_id"))


def rerank(spark, d):
    """The best 200 headlines for a query after the bonus for its words and for finance words."""
    news = headlines(spark, d).select("news_id", "text")
    scored = T.bm25(news, QUERY, key="news_id").join(news, "news_id").withColumnRenamed("bm25", "score")
    return _out(D.reranked(scored, QUERY, 200, "news_id").select("news_id", F.col("rerank_score").alias("score")))


def brackets(spark, d):
    rows = weekly_bars(spark, d).withColumns({"enter": F.coalesce(change("close") > 0, F.lit(False)), "leave": F.coalesce(change("close") < -0.2, F.lit(False))})
    return _out(R.bracketed(rows, 0.1, 0.08))


_TERMS = sorted(QUERY.split())
_SCORE = """d AS (SELECT doc_id, source, quality AS y, n_chars / (n_chars + 1500.0) AS p FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM d),
  g AS (SELECT source, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auc, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) - greatest(avg(y), 1 - avg(y)), 9) AS edge FROM r GROUP BY source),
  q AS (SELECT d.*, CASE WHEN auc IS NULL OR edge IS NULL THEN 'Unknown' WHEN auc >= 0.60 AND edge >= 0.05 THEN 'Strong' WHEN auc >= 0.55 AND edge >= 0.02 THEN 'Moderate' ELSE 'Weak' END AS quality FROM d JOIN g USING (source)),
  s AS (SELECT *, CASE WHEN quality = 'Weak' THEN 'No Edge / Neutral' WHEN p >= 0.57 THEN 'Bullish' WHEN p <= 0.43 THEN 'Bearish' ELSE 'Neutral' END AS signal, CASE WHEN p >= 0.65 OR p <= 0.35 THEN 'High' WHEN p >= 0.57 OR p <= 0.43 THEN 'Moderate' ELSE 'Low' END AS confidence FROM q)"""
_ANNUAL = lambda name, kinds: f"""{name} AS (SELECT entity, year, arg_max(value, (filed, seq)) AS value FROM (SELECT *, min(list_position({kinds}, concept)) OVER (PARTITION BY entity) AS first FROM f WHERE list_contains({kinds}, concept)) WHERE list_position({kinds}, concept) = first GROUP BY 1, 2)"""



def label_sql(name: str) -> str:
    """plain_label in SQL."""
    made = f"trim(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    for end in R.COMPANY_ENDINGS:
        made = f"trim(regexp_replace({made}, '{end}$', ''))"
    return made


_LABEL = label_sql("n")

QUERIES = {
    "signal_classes": signals, "fundamentals_annual": fundamentals, "prices_by_type": prices, "observations_json": observations, "observations_series": series, "book_summary": book, "book_stress": stress,
    "graph_labels": labels, "records_health": health, "records_health_days": health_days, "records_evidence": evidence, "text_segments": segments, "risk_ewma": ewma, "risk_ewm_deviation": ewm_deviation, "risk_rolling_var": rolling_value_at_risk, "quote_page": quote, "records_snapshots": snapshots, "search_rerank": rerank, "strategy_brackets": brackets,
}

ORACLE_SQL = {
    "signal_classes": f"""WITH {_SCORE} SELECT doc_id, quality, signal, confidence, CASE WHEN signal = 'Bullish' AND y = 0 THEN 'Neutral' WHEN signal <> 'Neutral' AND y <> 0 AND confidence = 'Low' THEN 'Neutral' ELSE signal END AS adjusted FROM s""",
    "fundamentals_annual": f"""WITH f AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS concept, o_totalprice AS value, o_orderdate AS filed, o_orderkey AS seq FROM orders), {_ANNUAL('r', "['F', 'O']")}, {_ANNUAL('c', "['P']")}
        SELECT r.entity, r.year, round(r.value, 6) AS revenue, round(c.value, 6) AS cost, round(1 - c.value / r.value, 6) AS margin, round(r.value / lag(r.value) OVER (PARTITION BY r.entity ORDER BY r.year) - 1, 6) AS growth FROM r LEFT JOIN c ON r.entity = c.entity AND r.year = c.year""",
    "prices_by_type": "SELECT p_type, round(median(p_retailprice), 6) AS median, round(min(p_retailprice), 6) AS low, round(max(p_retailprice), 6) AS high, count(DISTINCT p_size) AS sizes, round(count(p_retailprice) / count(*), 6) AS completeness FROM part GROUP BY p_type",
    "observations_json": "WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, round(avg(k), 6) AS mean, max(k) AS top, count(k) AS n, coalesce(avg(k) > 50, false) AS alert FROM e GROUP BY event_type",
    "observations_series": "SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2 HAVING avg(value) IS NOT NULL",
    "book_summary": f"SELECT c_mktsegment, {sql(net='sum(c_acctbal)', gross='sum(abs(c_acctbal))', long='sum(greatest(c_acctbal, 0))', short='sum(least(c_acctbal, 0))', concentration='max(abs(c_acctbal)) / sum(abs(c_acctbal))')}, count(*) AS n FROM customer GROUP BY 1",
    "book_stress": f"WITH b AS (SELECT c_mktsegment, sum(c_acctbal) AS net FROM customer GROUP BY 1) SELECT c_mktsegment, scenario, round(net * 1.2::DOUBLE * shock, 6) AS loss FROM b, (VALUES {', '.join(f'({n!r}, {s}::DOUBLE)' for n, s in R.STRESS)}) t(scenario, shock)",
    "graph_labels": f"""WITH n AS (SELECT p_partkey, p_name || ', Co. Ltd' AS n FROM part) SELECT p_partkey, {_LABEL} AS label,
        coalesce(nullif(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'node') AS slug FROM n""",
    "records_health": """WITH e AS (SELECT user_id, event_type, list_position(['purchase', 'signup', 'click'], event_type) AS o FROM events)
        SELECT user_id, arg_min(event_type, o) FILTER (o > 0) AS status, count(*) AS n FROM e GROUP BY user_id""",
    "records_health_days": """WITH e AS (SELECT user_id || ' ' || CAST(ts AS DATE) AS user_day, event_type, list_position(['purchase', 'signup', 'click'], event_type) AS o FROM events)
        SELECT user_day, arg_min(event_type, o) FILTER (o > 0) AS status, count(*) AS n FROM e GROUP BY user_day""",
    "records_evidence": f"WITH l AS ({market.ORACLE_SQL['records_licences']}), s AS (SELECT s_nationkey, status FROM l JOIN supplier ON s_suppkey = dataset) SELECT s_nationkey, count(*) FILTER (status = 'ACTIVE') AS shown, count(*) AS n, CASE WHEN count(*) FILTER (status = 'ACTIVE') = 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (status = 'ACTIVE') < count(*) THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability FROM s GROUP BY 1",
    "text_segments": f"WITH {NEWS} " + " UNION ALL ".join(f"SELECT customer, '{k}' AS segment, count(*) AS n, round(least(1, greatest(0, 0.5 + 0.05 * sum(g) - 0.05 * sum(r))), 6)::DOUBLE AS sentiment, round(least(1, 0.5 + 0.1 * sum(g)), 6)::DOUBLE AS growth, round(least(1, 0.5 + 0.1 * sum(r)), 6)::DOUBLE AS risk FROM (SELECT customer, lower(coalesce(text, '')) AS t, CAST(regexp_matches(t, '{'|'.join(R.GROWING)}') AS INTEGER) AS g, CAST(regexp_matches(t, '{'|'.join(R.AT_RISK)}') AS INTEGER) AS r FROM news) WHERE regexp_matches(t, '{'|'.join(v)}') GROUP BY customer" for k, v in R.SEGMENTS.items()),
    "risk_ewm_deviation": f"""WITH RECURSIVE {WEEKLY}, r AS (SELECT ticker, date, close / lag(close) {OVER} - 1 AS r FROM bars),
        o AS (SELECT *, row_number() {OVER} AS i FROM r WHERE r IS NOT NULL),
        e AS (SELECT ticker, date, i, r AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS s FROM o WHERE i = 1
          UNION ALL SELECT o.ticker, o.date, o.i, m + 0.06::DOUBLE * (r - m), 0.94::DOUBLE * (v + 0.06::DOUBLE * (r - m) * (r - m)),
            0.94::DOUBLE * 0.94::DOUBLE * s + 0.06::DOUBLE * 0.06::DOUBLE FROM e JOIN o ON o.ticker = e.ticker AND o.i = e.i + 1)
        SELECT ticker, date, CASE WHEN i > 1 THEN round(sqrt(v / (1 - s)) * sqrt(252), 6) END AS ewm_deviation FROM e""",
    "risk_rolling_var": f"""WITH {WEEKLY}, r AS (SELECT ticker, date, close / lag(close) {OVER} - 1 AS r FROM bars), k AS (SELECT * FROM r WHERE r IS NOT NULL)
        SELECT ticker, date, round(CASE WHEN count(*) OVER w = 252 THEN -quantile_cont(r, 0.05) OVER w END, 6) AS var FROM k
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""",
    "risk_ewma": f"""WITH RECURSIVE {WEEKLY}, r AS (SELECT ticker, date, close / lag(close) {OVER} - 1 AS r FROM bars), o AS (SELECT *, row_number() {OVER} AS i FROM r WHERE r IS NOT NULL),
        e AS (SELECT ticker, date, i, r * r AS v FROM o WHERE i = 1 UNION ALL SELECT o.ticker, o.date, o.i, 0.94::DOUBLE * v + (1 - 0.94::DOUBLE) * r * r FROM e JOIN o ON o.ticker = e.ticker AND o.i = e.i + 1) SELECT ticker, date, round(sqrt(v) * sqrt(252), 6) AS ewma_vol FROM e""",
    "quote_page": f"""WITH {WEEKLY}, w AS (SELECT *, min(low) OVER n AS lo, max(high) OVER n AS hi, last_value(close) OVER a AS spot, max(year(date)) OVER (PARTITION BY ticker) AS y FROM bars
        WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT ticker, {sql(close='max(spot)', range_position='arg_max((close - lo) / (hi - lo), date)', year_to_date='max(spot) / arg_min(close, date) FILTER (year(date) = y) - 1', percentile='avg(CAST(close < spot AS DOUBLE))')} FROM w GROUP BY ticker""",
    "records_snapshots": "SELECT c_custkey, sha256(CAST(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment}) AS VARCHAR)) AS snapshot_id FROM customer",
    "search_rerank": f"""WITH {NEWS}, d AS (SELECT news_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM news), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
        f AS (SELECT news_id, t, len(w) AS len, x.term, len(list_filter(w, lambda y: y = x.term)) AS tf FROM d, (VALUES {", ".join(f"('{t}')" for t in _TERMS)}) x(term)), g AS (SELECT * FROM f WHERE tf > 0), i AS (SELECT term, count(*) AS df FROM g GROUP BY term),
        b AS (SELECT news_id, any_value(t) AS t, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS s FROM g JOIN i USING (term), c GROUP BY news_id),
        z AS (SELECT news_id, s + 0.1 * ({" + ".join(f"CAST(contains(t, '{t}') AS INTEGER)" for t in _TERMS)}) + 0.05 * ({" + ".join(f"CAST(contains(t, '{t}') AS INTEGER)" for t in D.FINANCE_WORDS)}) AS score FROM b) SELECT news_id, round(score, 6) AS score FROM z ORDER BY round(z.score, 9) DESC, news_id LIMIT 200""",
}
