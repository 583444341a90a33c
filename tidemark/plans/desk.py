"""Queries of a research desk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.draws import normal_sql
from tidemark.operators import desk as D
from tidemark.functions.canonical import snapshot_ids as snapshot_names
from tidemark.operators import evidence as E
from tidemark.operators import learn as L
from tidemark.operators import research as R
from tidemark.operators import stats as S
from tidemark.operators import text as T
from tidemark.plans import evidence as V
from tidemark.plans import text as W
from tidemark.plans.research import _SCORE
from tidemark.plans.sql import OVER, WEEKLY, out, rolling
from tidemark.plans.sql import rounded as sql
from tidemark.plans.stats import _PAIR, _R, _pair
from tidemark.sources.bars import table, weekly_bars
from tidemark.sources.news import headlines
from tidemark.sources.providers import PROVIDERS, provider

CONCEPTS = tuple(sorted({c for _, a, b in D.RATIOS for c in (a, b)}))
FORMS = ("10-K", "10-q", "8-K", "10-Q")
STEPS = [0, 1, 13, 26, 52]
COUNTRIES = (("IND", 8), ("USA", 24))


def institutional(spark, d):
    """Documents of each source by a length score whose quality is judged per source; one of them is missing a score."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    per = L.scores(docs, ["source"]).select("source", F.round("auc", 9).alias("auc"), F.round(F.col("accuracy") - F.col("baseline"), 9).alias("edge"))
    rows = docs.join(per, "source").select("doc_id", "p", R.signal_quality(F.col("auc"), F.col("edge")).alias("quality"))
    return out(D.institutional(rows).select("doc_id", "signal", "strength", "confidence", "allowed", "used", "explanation"))


def fundamental_ratios(spark, d):
    k = F.col("o_orderkey")
    concept = F.get(F.array(*map(F.lit, CONCEPTS)), (k % len(CONCEPTS)).cast("int"))
    facts = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("entity"), F.year("o_orderdate").alias("year"), concept.alias("concept"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("filed"), k.alias("seq"))
    return out(D.fundamental_ratios(facts))


def news_signal(spark, d):
    return out(D.news_signal(T.news_impact(headlines(spark, d), "ACME", related="related"), "customer"))


def drawdowns(spark, d):
    return out(D.drawdown_features(weekly_bars(spark, d)).select("ticker", "date", "drawdown_from_252_high", "max_drawdown_60", "price_to_sma_50", "price_to_sma_200", "trend_strength_50_200"))


def daily_volatility(spark, d):
    r = F.when(S.clean("r"), F.col("r"))
    rows = S.with_returns(weekly_bars(spark, d)).groupBy("ticker").agg(F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("daily_volatility"))
    return out(rows)


def filings(spark, d):
    """A customer's orders as filings, in parallel arrays."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", k, F.struct(k.alias("k"), F.get(F.array(*map(F.lit, FORMS)), (k % 4).cast("int")).alias("form"), F.when(k % 11 > 0, F.concat(F.lit("000-"), k)).otherwise("").alias("accession"),
                                                                    F.when(k % 13 > 0, F.concat(F.lit("d"), k, F.lit(".htm"))).alias("document"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed")).alias("x"))
    packed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return D.filings(packed.select(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.col("o_custkey").alias("cik"), *[F.col(f"x.{c}").alias(c) for c in ("form", "accession", "document", "filed")]))


def _snapshots(spark, d):
    """Answers to a request for each customer: half of the requests and answers have their keys in another order, and a secret."""
    nation, even = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 2 == 0
    params = F.when(even, F.concat(F.lit('{"page": 1, "nation": '), nation, F.lit("}"))).otherwise(
        F.concat(F.lit('{"nation":'), nation, F.lit(',"Api_Key":"s'), F.col("c_custkey"), F.lit('","page":1}'))
    )
    name = F.col("c_name")
    payload = F.when(even, F.concat(F.lit('{"rows": [{"b": 1, "a": "'), name, F.lit('"}], "n": 1}'))).otherwise(
        F.concat(F.lit('{"n":1,"rows":[{"a":"'), name, F.lit('","b":1}]}'))
    )
    ids = snapshot_names(F.col("c_mktsegment"), F.concat(F.lit("http://x/"), nation), params, payload)
    return table(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in ids.items()])


def snapshot_ids(spark, d):
    return _snapshots(spark, d)


def snapshot_by_id(spark, d):
    rows = _snapshots(spark, d)
    wanted = rows.filter("c_custkey <= 5").select("snapshot_id")
    return D.snapshot_by_id(rows, wanted.union(spark.range(1).select(F.lit("no id"))))


def recorded_snapshots(spark, d):
    """How many answers of each segment's request there are after all were recorded again beside the first half."""
    rows = _snapshots(spark, d)
    return D.recorded_snapshots(rows.filter("c_custkey % 2 = 0"), rows).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


def rolling_correlation(spark, d):
    return out(D.rolling_correlation(_pair(spark, d)))


def calibrated(spark, d):
    bars = weekly_bars(spark, d)
    start = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("start"))
    params = S.summary(bars).select("ticker", F.col("cagr").alias("mu"), F.col("volatility").alias("sigma")).join(start, "ticker")
    return out(D.fan(D.calibrated_paths(params), STEPS), 3)


def company(spark, d):
    """Customers' tickers with their profiles and how sure the evidence of their country is."""
    rows = V.profiles(spark, d)
    codes = F.create_map(*[F.lit(x) for pair in COUNTRIES for x in pair])
    sure = E.confidence(V._series(spark, d), "country", F.lit(V.DAY)).select("country", "status", "score")
    return rows.withColumn("country", F.try_element_at(codes, F.col("country_code"))).join(sure, "country", "left").select("c_custkey", "ticker", "company", "status", "score")


def providers(spark, d):
    """Rows and tickers of each source of bars."""
    rows = None
    for name in sorted(PROVIDERS):
        one = provider(name.upper())(spark, d).agg(F.lit(name).alias("provider"), F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def book_value(spark, d):
    pnl = F.col("c_acctbal") * ((F.col("c_custkey") % 7 - 3) / 100)
    return out(D.book_value(table(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("mv"), pnl.alias("pnl")), "c_mktsegment"), 4)


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_LATEST = ", ".join(f"arg_max(value, year) FILTER (concept = '{c}') AS {c}" for c in CONCEPTS)
_IMPACT = W.ORACLE_SQL["text_news_impact"]
_SNAP = """sn AS (SELECT c_custkey,
    sha256('{"params":{"nation":' || c_nationkey || ',"page":1},"provider":"' || c_mktsegment || '","source_url":"http://x/' || c_nationkey || '"}') AS request_id,
    sha256('{"n":1,"rows":[{"a":"' || c_name || '","b":1}]}') AS content_hash FROM customer),
  si AS (SELECT *, sha256(request_id || ':' || content_hash) AS snapshot_id FROM sn)"""
_CAL = f"""{_R}, g AS (SELECT ticker, arg_max(close, date) AS start, pow(arg_max(close, date) / arg_min(close, date), 365.25 / date_diff('day', min(date), max(date))) - 1 AS mu, stddev_samp(r) * sqrt(252) AS sigma FROM t GROUP BY ticker),
  z AS (SELECT ticker, sim, step, start, CASE WHEN step > 0 THEN (coalesce(nullif(mu, 0), 0.08) - coalesce(nullif(sigma, 0), 0.2) * coalesce(nullif(sigma, 0), 0.2) / 2) / 52 + coalesce(nullif(sigma, 0), 0.2) * sqrt(1 / 52) * {normal_sql('ticker', 'sim', 'step', seed=42)} ELSE 0 END AS z
    FROM g, range(500) a(sim), range(53) b(step)), p AS (SELECT ticker, step, start * exp(sum(z) OVER (PARTITION BY ticker, sim ORDER BY step)) AS price FROM z)"""

QUERIES = {
    "signal_institutional": institutional, "fundamentals_ratios": fundamental_ratios, "text_news_signal": news_signal, "window_drawdowns": drawdowns, "stats_daily_volatility": daily_volatility, "records_filings": filings,
    "records_snapshot_ids": snapshot_ids, "records_snapshot_by_id": snapshot_by_id, "records_snapshots_again": recorded_snapshots, "join_rolling_correlation": rolling_correlation, "simulate_calibrated": calibrated,
    "evidence_company": company, "scan_providers": providers, "book_value": book_value,
}

ORACLE_SQL = {
    "signal_institutional": f"""WITH {_SCORE}, b AS (SELECT *, CASE WHEN p >= 0.57 THEN 'Bullish' WHEN p <= 0.43 THEN 'Bearish' ELSE 'Neutral' END AS base FROM s)
        SELECT doc_id, signal, CASE WHEN quality = 'Weak' THEN 'Low' ELSE confidence END AS strength, confidence, quality <> 'Weak' AS allowed, round(CASE WHEN p >= 0.57 THEN p WHEN p <= 0.43 THEN 1 - p ELSE greatest(p, 1 - p) END, 6)::DOUBLE AS used,
        CASE WHEN quality = 'Weak' THEN printf('The model''s out-of-sample validation edge is weak (ROC-AUC < 0.55 or Edge < 2%%). Although the raw probability suggests a %s move (%.1f%%), the signal is suppressed. This indicates the model cannot reliably separate noise from signal.', base, p::DOUBLE * 100)
        ELSE printf('The model output places this asset in the %s zone. Validation quality is %s. Probability of an upward move is %.1f%%. Research confidence is rated as %s based on institutional confidence bands.', signal, quality, p::DOUBLE * 100, confidence) END AS explanation FROM b""",
    "fundamentals_ratios": f"""WITH f AS (SELECT o_custkey % 40 AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, list_extract({_list(CONCEPTS)}, 1 + o_orderkey % {len(CONCEPTS)}) AS concept, o_totalprice AS value, o_orderdate AS filed, o_orderkey AS seq FROM orders),
        a AS (SELECT entity, concept, year, arg_max(value, (filed, seq)) AS value FROM f GROUP BY 1, 2, 3), b AS (SELECT *, lag(value) OVER (PARTITION BY entity, concept ORDER BY year) AS before FROM a),
        l AS (SELECT entity, max(year) FILTER (concept = 'revenue') AS latest_year, {_LATEST}, arg_max(struct_pack(g := value / nullif(before, 0) - 1), year) FILTER (concept = 'revenue') AS gg FROM b GROUP BY entity)
        SELECT entity, latest_year, {", ".join(f"round({a} / nullif({b}, 0), 6) AS {n}" for n, a, b in D.RATIOS)}, round(gg.g, 6) AS revenue_growth FROM l""",
    "text_news_signal": f"""WITH i AS ({_IMPACT.replace('SELECT news_id, event,', 'SELECT news_id, customer, score, event,')}), w AS (SELECT *, greatest(0.05, round_even(round(confidence * 100, 9), 0) / 100) * greatest(0.1, materiality / 100) AS wt FROM i),
        g AS (SELECT customer, count(*) AS headlines, CAST(sum(CAST(relevance = 'PROVIDER-TAGGED' AS INTEGER)) AS BIGINT) AS provider_tagged, sum(score * wt) / sum(wt) AS s FROM w GROUP BY customer)
        SELECT customer, headlines, provider_tagged, round_even(round(s, 9), 3) AS score, CASE WHEN s > 0.12 THEN 'BULLISH SKEW' WHEN s < -0.12 THEN 'BEARISH SKEW' ELSE 'MIXED / WAIT' END AS label,
        CAST(round_even(round(greatest(5, least(95, 50 + s * 42)), 9), 0) AS INTEGER) AS bullish, CAST(round_even(round(greatest(5, least(95, 50 - s * 42)), 9), 0) AS INTEGER) AS bearish,
        CAST(round_even(round(least(96, 24 + provider_tagged / headlines * 48 + least(headlines, 8) * 3), 9), 0) AS INTEGER) AS confidence FROM g""",
    "window_drawdowns": f"""WITH {WEEKLY}, a AS (SELECT *, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS d60, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS d252,
          {rolling('avg', 'close', 50)} AS m50, {rolling('avg', 'close', 200)} AS m200 FROM bars)
        SELECT ticker, date, {sql(drawdown_from_252_high='d252', max_drawdown_60='min(d60) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)', price_to_sma_50='close / m50 - 1', price_to_sma_200='close / m200 - 1', trend_strength_50_200='m50 / m200 - 1')} FROM a""",
    "stats_daily_volatility": f"WITH {_R} SELECT ticker, round(coalesce(stddev_samp(r), 0), 6) AS daily_volatility FROM t GROUP BY ticker",
    "records_filings": f"""WITH f AS (SELECT 'C' || o_custkey AS ticker, o_custkey AS cik, o_orderkey AS k, list_extract({_list(FORMS)}, 1 + o_orderkey % 4) AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k) AS rank FROM f WHERE upper(form) IN ('10-K', '10-Q'))
        SELECT ticker, CAST(rank AS INTEGER) AS rank, form, CAST(filed AS VARCHAR) AS filed, '000-' || k AS accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/000' || k || '/d' || k || '.htm' AS url FROM r WHERE rank <= 2""",
    "records_snapshot_ids": f"WITH {_SNAP} SELECT * FROM si",
    "records_snapshot_by_id": f"WITH {_SNAP} SELECT * FROM si WHERE c_custkey <= 5",
    "records_snapshots_again": f"WITH {_SNAP} SELECT request_id, count(DISTINCT snapshot_id) AS n FROM si GROUP BY 1",
    "join_rolling_correlation": f"""WITH {_PAIR.replace('SELECT a.r AS ra', 'SELECT date, a.r AS ra')}, c AS (SELECT date, CASE WHEN count(*) OVER w >= 60 THEN corr(ra, rb) OVER w END AS corr FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
        n AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM c WHERE corr IS NOT NULL) SELECT date, round(corr, 6) AS corr FROM n WHERE i % CASE WHEN n > 40 THEN n // 40 + 1 ELSE 1 END = 0""",
    "simulate_calibrated": f"""WITH {_CAL} SELECT ticker, CAST(step AS INTEGER) AS step, {", ".join(f"round(quantile_cont(price, {s}), 3) AS p{round(100 * s)}" for s in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM p WHERE step IN ({", ".join(map(str, STEPS))}) GROUP BY 1, 2""",
    "evidence_company": f"""WITH p AS ({V.ORACLE_SQL['records_profiles']}), e AS ({V.ORACLE_SQL['evidence_pulse']})
        SELECT c_custkey, ticker, company, e.status, e.score FROM p LEFT JOIN e ON e.country = CASE country_code WHEN 'IND' THEN 8 WHEN 'USA' THEN 24 END""",
    "scan_providers": f"""WITH {WEEKLY} SELECT 'weekly' AS provider, count(*) AS n, count(DISTINCT ticker) AS tickers FROM bars
        UNION ALL SELECT 'segments', count(DISTINCT (c_mktsegment, CAST(o_orderdate AS DATE))), count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT 'ticks', count(DISTINCT (event_type, date_trunc('hour', ts))), count(DISTINCT event_type) FROM events WHERE value IS NOT NULL""",
    "book_value": f"""WITH p AS (SELECT c_mktsegment, c_acctbal AS mv, c_acctbal * ((c_custkey % 7 - 3) / 100) AS pnl FROM customer)
        SELECT c_mktsegment, {", ".join(f"round({v}, 4) AS {k}" for k, v in {'nav': f'{D.NAV_BASE} + sum(pnl)', 'gross': 'sum(abs(mv))', 'net': 'sum(mv)', 'long': 'sum(greatest(mv, 0))', 'short': 'sum(least(mv, 0))', 'pnl_day': 'sum(pnl)'}.items())} FROM p GROUP BY 1""",
}
