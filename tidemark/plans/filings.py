"""Queries of documents, links, candidates, contexts, briefs and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import filings as D
from tidemark.operators import text as T
from tidemark.plans.sql import out
from tidemark.sources.bars import table
from tidemark.sources.news import NEWS, headlines

QUERY = "market risk growth"
KINDS = ("annual_report", "investor_presentation", "earnings_transcript", "news")
SOURCES = ("Official IR", "NSE", "BSE", "Screener.in", "Web Search", "Blog")
LINKS = ("Annual Report {k}", "Credit rating", "Concall transcript", "Investor presentation", "Home", "Results Q2")
HREFS = ("/docs/annual-report-{k}.pdf", "https://z.org/{k}.html", "../up/{k}.txt", "file-{k}.pdf", "announcement/{k}", "//cdn.org/{k}")
RECORD = ("overall_sentiment_score", "risk_score", "growth_score")


def _pick(words, n):
    return F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))


def document_ids(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", D.document_id(F.concat(F.col("p_name"), F.lit("/a b\\c.pdf")), F.when(k % 3 > 0, k)).alias("document_id"))


def urls(spark, d):
    k = F.col("p_partkey")
    url = F.replace(_pick(("http://a.b/x?q=1", "/abs/{k}?a=b", "rel/{k}.html#top", "../{k}", "./same/{k}/..", "//host/{k}", ""), k), F.lit("{k}"), k.cast("string"))
    base = F.when(k % 4 > 0, F.lit("https://site.org/a/b/page.html?x=1")).otherwise(F.lit(""))
    return table(spark, d, "part").select("p_partkey", D.absolute_url(url, base).alias("url"))


def financial(spark, d):
    news = headlines(spark, d)
    url = F.concat(F.lit("http://x/"), F.when(F.col("news_id") % 3 == 0, "annual-report").otherwise("page"))
    return news.select("news_id", D.is_financial(url, F.when(F.col("news_id") % 4 == 0, F.concat(F.col("text"), F.lit(" Press Release"))).otherwise(F.col("text"))).alias("financial"))


def _pages(spark, d):
    """Parts as pages with two links each."""
    k = F.col("p_partkey")
    fill = lambda words, n: F.replace(_pick(words, n), F.lit("{k}"), k.cast("string"))
    link = lambda n: F.concat(F.lit('<li><a class="x" href="'), fill(HREFS, n), F.lit('"><b>'), fill(LINKS, n), F.lit("</b></a>"))
    html = F.concat(F.lit("<html><body>"), link(k), F.lit("<p>text</p>"), link(k * 5 + 1), F.lit("</body></html>"))
    return table(spark, d, "part").select(k.alias("page_id"), F.lit("https://site.org/co/index.html").alias("url"), html.alias("html"))


def links(spark, d):
    return out(D.links(_pages(spark, d)))


def exchange_pages(spark, d):
    k = F.col("s_suppkey")
    return D.exchange_pages(table(spark, d, "supplier").select(F.concat(F.lit("S"), k, _pick((".NS", ".BO", ""), k)).alias("ticker")))


def _candidates(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey") % 50).alias("ticker"), _pick(SOURCES, k).alias("source_name"), _pick(KINDS, k * 3 + F.col("o_custkey")).alias("document_type"),
        F.concat(F.lit("http://x/"), k % 300, _pick((".pdf", "-2024.html", "-fy23.pdf", ""), k)).alias("document_url"), F.when(k % 7 == 0, "Report FY24").alias("title"), F.when(k % 5 > 0, (k % 10) / 10).alias("confidence"),
    )


def ranked(spark, d):
    rows = D.ranked_candidates(_candidates(spark, d))
    return out(rows.groupBy("source_name", "document_type", "document_url", "title", "confidence").agg(F.max("rank_score").alias("rank_score"), F.count(F.lit(1)).alias("n")))


def discovered(spark, d):
    rows = _candidates(spark, d)
    known = F.col("source_name").isin("NSE", "BSE")
    return out(D.discovered([rows.filter(known), rows.filter(~known)], list(KINDS[:3]), 5).select("ticker", "rank", "document_url", "source_name", "rank_score"))


def _chunks(spark, d):
    """The first five headlines of each customer as chunks; every fourth is long."""
    rows = headlines(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("customer").orderBy("news_id"))).filter("rank <= 5")
    text = F.when(F.col("news_id") % 4 == 0, F.repeat(F.concat(F.col("text"), F.lit("\n")), 30)).otherwise(F.col("text"))
    return rows.select("customer", "rank", text.alias("text"), F.when(F.col("news_id") % 3 > 0, F.concat("ticker", F.lit(".pdf"))).alias("source_file"), F.when(F.col("news_id") % 2 == 0, F.col("rank")).alias("page_number"))


def context(spark, d):
    return D.numbered_context(_chunks(spark, d), "customer").select("customer", F.length("context").alias("n"), F.md5(F.col("context").cast("binary")).alias("digest"))


def cited(spark, d):
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("As ["), k % 9, F.lit("] and ["), k % 4, F.lit("][99999999999999999999] say [x] ["), k % 9, F.lit("]"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(D.cited(answer, 6).cast("array<string>"), ",").alias("cited"))


def plain_answers(spark, d):
    rows = D.plain_answers(_chunks(spark, d), "customer", QUERY)
    return rows.select("customer", F.md5(F.col("answer").cast("binary")).alias("digest"), F.array_join("sources", ";").alias("sources"))


def briefs(spark, d):
    return D.briefs(headlines(spark, d), "customer", "news_id")


def snapshots(spark, d):
    k = F.col("s_suppkey")
    some = lambda n, m: F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when((k + i) % m == 0, F.concat(F.lit(n), i.cast("string"))))
    words = lambda n, m: F.filter(some(n, m), lambda x: x.isNotNull())
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("About "), "s_name")).alias("about"), F.create_map(F.lit("Nation"), F.col("s_nationkey").cast("string"), F.lit("Key"), k.cast("string")).alias("metrics"),
                                              words("good ", 3).alias("pros"), words("bad ", 8).alias("cons"), words("P", 1).alias("peers"))
    return D.snapshot_text(rows).select("s_suppkey", F.col("summary").alias("text"))


def scenarios(spark, d):
    rows = T.news_impact(headlines(spark, d), "ACME", related="related")
    return D.scenario_texts(rows, "ACME").select("news_id", "event", "base", "upside", "downside")


def first_json(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('Sure: ```json {"b": {"a": '), k, F.lit('}, "a": [1]} ``` and {"x": 1}'))).when(k % 4 == 1, F.concat(F.lit('{"open": '), k)).when(k % 4 == 2, "no object").otherwise("{not json}")
    return D.first_json(table(spark, d, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", "json")


def factor_frame(spark, d):
    k = F.col("o_orderkey")
    payload = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of_date"), F.concat(F.lit("T"), F.col("o_custkey")).alias("ticker"), F.when(k % 3 > 0, (k % 20) / 10 - 1).alias(RECORD[0]), ((k % 10) / 10).alias(RECORD[1])))
    rows = D.factor_frame(table(spark, d, "orders").select(k, payload.alias("payload")))
    return out(rows.groupBy("date").agg(F.count("ticker").alias("n"), *[F.avg(c).alias(c) for c in RECORD]))


def answer(spark, d):
    """The headlines of one ticker by the words of a query, the best 400, of them the best 100 after the bonus."""
    news = D.scoped(headlines(spark, d), "OMEGA.NS")
    found = T.bm25(news, QUERY, key="news_id")
    ends = found.agg(F.max("bm25").alias("most"))
    best = found.join(F.broadcast(ends)).select("news_id", (0.3 * F.col("bm25") / F.col("most")).alias("score")).orderBy(F.desc(F.round("score", 9)), "news_id").limit(400)
    return out(D.reranked(best.join(news.select("news_id", "text"), "news_id"), QUERY, 100, "news_id").select("news_id", "rerank_score"))


def unscoped(spark, d):
    """A ticker without headlines is searched for in all of them."""
    return D.scoped(headlines(spark, d), "NONE").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def index(spark, d):
    rows = D.index(table(spark, d, "embeddings"))
    return out(rows.select("vec_id", T.dot(F.col("unit"), F.col("unit")).alias("length"), F.get("unit", F.lit(0)).alias("first")))


def filtered(spark, d):
    return out(D.retrieved(D.index(table(spark, d, "embeddings")), 0, 5, {"label": 0}).select("vec_id", "label", "score"))


_list = lambda words: "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"
_of = lambda words, n: f"list_extract({_list(words)}, CAST(1 + ({n}) % {len(words)} AS BIGINT))"
_any = lambda text, words: f"regexp_matches({text}, '{'|'.join(words)}')"
_count = lambda text, words: "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"
_fill = lambda words, n: f"replace({_of(words, n)}, '{{k}}', CAST(p_partkey AS VARCHAR))"
# what the link of each kind becomes when it is joined to https://site.org/co/index.html
_JOINED = ("https://site.org/docs/annual-report-{k}.pdf", "https://z.org/{k}.html", "https://site.org/up/{k}.txt", "https://site.org/co/file-{k}.pdf", "https://site.org/co/announcement/{k}", "https://cdn.org/{k}")
_TYPES = ("annual_report", "credit_rating", "earnings_transcript", "investor_presentation", "announcements", "quarterly_result")
_LINKS = " UNION ALL ".join(f"SELECT p_partkey AS page_id, {p} AS place, {_fill(LINKS, n)} AS title, {_fill(_JOINED, n)} AS document_url, {_of(_TYPES, n)} AS document_type FROM part" for p, n in enumerate(("p_partkey", "p_partkey * 5 + 1")))
_CANDIDATES = f"""cd AS (SELECT 'T' || (o_custkey % 50) AS ticker, {_of(SOURCES, 'o_orderkey')} AS source_name, {_of(KINDS, 'o_orderkey * 3 + o_custkey')} AS document_type, 'http://x/' || (o_orderkey % 300) || {_of(('.pdf', '-2024.html', '-fy23.pdf', ''), 'o_orderkey')} AS document_url,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Report FY24' END AS title, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10 END AS confidence FROM orders),
  rk AS (SELECT *, (CASE source_name WHEN 'Official IR' THEN 40 WHEN 'NSE' THEN 35 WHEN 'BSE' THEN 35 WHEN 'Screener.in' THEN 25 WHEN 'Web Search' THEN 15 ELSE -5 END + CASE WHEN document_url LIKE '%.pdf' THEN 20 ELSE 0 END
    + CASE document_type WHEN 'annual_report' THEN 15 WHEN 'investor_presentation' THEN 12 WHEN 'earnings_transcript' THEN 10 ELSE 0 END
    + CASE WHEN document_url LIKE '%2024%' OR title IS NOT NULL THEN 10 WHEN document_url LIKE '%fy23%' THEN 5 ELSE 0 END) * coalesce(confidence, 0.5) AS rank_score FROM cd)"""
_CHUNKS = f"""{NEWS}, ck AS (SELECT customer, row_number() OVER (PARTITION BY customer ORDER BY news_id) AS rank, CASE WHEN news_id % 4 = 0 THEN repeat(text || chr(10), 30) ELSE text END AS text, CASE WHEN news_id % 3 > 0 THEN ticker || '.pdf' END AS source_file, news_id % 2 = 0 AS paged FROM news),
  cl AS (SELECT *, coalesce(source_file, 'Unknown') || ' (Page ' || CASE WHEN paged THEN CAST(rank AS VARCHAR) ELSE 'N/A' END || ')' AS label, trim(text, ' ') AS t0, replace(trim(text, ' '), chr(10), ' ') AS t FROM ck WHERE rank <= 5)"""
_SCENE = f"""w AS (SELECT *, string_split_regex(lower(text), '[^a-z0-9'']+') AS v, regexp_extract_all(lower(text), '[a-z'']+') AS u FROM news)"""
_BM = f"""d AS (SELECT news_id, string_split_regex(lower(text), '\\s+') AS w, lower(text) AS t FROM news WHERE ticker = 'OMEGA.NS'), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
  f AS (SELECT news_id, len(w) AS len, x.term, len(list_filter(w, lambda y: y = x.term)) AS tf FROM d, (VALUES ('market'), ('risk'), ('growth')) x(term)), g AS (SELECT * FROM f WHERE tf > 0), i AS (SELECT term, count(*) AS df FROM g GROUP BY term),
  b AS (SELECT news_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS bm FROM g JOIN i USING (term), c GROUP BY news_id)"""

QUERIES = {
    "text_document_ids": document_ids, "text_urls": urls, "text_financial": financial, "text_links": links, "text_exchange_pages": exchange_pages, "text_ranked_candidates": ranked, "text_discovered": discovered,
    "text_context": context, "text_cited": cited, "text_plain_answers": plain_answers, "text_briefs": briefs, "text_snapshots": snapshots, "text_scenarios": scenarios, "text_first_json": first_json,
    "records_factor_frame": factor_frame, "search_answer": answer, "search_unscoped": unscoped, "search_index": index, "search_filtered": filtered,
}


def _scene(i: int) -> str:
    from tidemark.operators.filings import KPIS, OTHER_KPI, SCENARIOS

    kpi = "CASE event " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KPIS) + f" ELSE '{OTHER_KPI}' END"
    return f"replace(replace(CASE WHEN score > 0.12 THEN '{SCENARIOS['up'][i]}' WHEN score < -0.12 THEN '{SCENARIOS['down'][i]}' ELSE '{SCENARIOS['open'][i]}' END, '{{kpi}}', {kpi}), '{{ticker}}', 'ACME')"


def _events_sql() -> str:
    from tidemark.functions import lexicon as L

    kinds = ", ".join(f"{{'hits': len(list_intersect(list_distinct(v), {_list(words)})), 'o': {-i}, 'name': '{n}'}}" for i, (n, _, words) in enumerate(L.EVENTS))
    return f"""{_SCENE}, e AS (SELECT *, len(list_filter(u, lambda x: list_contains({_list(L.POSITIVE)}, x))) AS p, len(list_filter(u, lambda x: list_contains({_list(L.NEGATIVE)}, x))) AS n,
      coalesce(list_max(list_filter([{kinds}], lambda x: x.hits > 0)).name, '{L.OTHER_EVENT[0]}') AS event FROM w), s AS (SELECT *, round_even(coalesce((p - n) / nullif(p + n, 0), 0), 3) AS score FROM e)"""


ORACLE_SQL = {
    "text_document_ids": r"SELECT p_partkey, replace(replace(replace(p_name || '/a b\c.pdf', ' ', '_'), '/', '_'), '\', '_') || CASE WHEN p_partkey % 3 > 0 THEN '_p' || p_partkey ELSE '' END AS document_id FROM part",
    "text_urls": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'http://a.b/x?q=1' WHEN p_partkey % 7 = 6 OR p_partkey % 4 = 0 THEN '' ELSE list_extract(['https://site.org/abs/' || p_partkey || '?a=b', 'https://site.org/a/b/rel/' || p_partkey || '.html#top',
        'https://site.org/a/' || p_partkey, 'https://site.org/a/b/same/', 'https://host/' || p_partkey], p_partkey % 7) END AS url FROM part""",
    "text_financial": f"WITH {NEWS} SELECT news_id, news_id % 3 = 0 OR news_id % 4 = 0 OR {_any('lower(text)', D.FINANCIAL)} AS financial FROM news",
    "text_links": f"""WITH l AS ({_LINKS}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rank FROM l WHERE title <> 'Home' OR document_type = 'announcements')
        SELECT page_id, CAST(rank AS INTEGER) AS rank, document_url, title, document_type, CASE WHEN document_url LIKE '%.pdf' THEN 0.9::DOUBLE ELSE 0.8 END AS confidence,
        document_url LIKE '%.pdf' OR document_url LIKE '%.txt' OR document_url LIKE '%.html' AS downloadable FROM r""",
    "text_exchange_pages": """WITH t AS (SELECT 'S' || s_suppkey AS s, s_suppkey % 3 AS k FROM supplier)
        SELECT s || '.NS' AS ticker, 'NSE' AS source_name, 'https://www.nseindia.com/get-quotes/equity?symbol=' || s AS document_url, 'NSE Corporate Filings for ' || s AS title, 'source_page' AS document_type, 0.9::DOUBLE AS confidence, false AS downloadable FROM t WHERE k = 0
        UNION ALL SELECT s || CASE k WHEN 0 THEN '.NS' ELSE '.BO' END, 'BSE', 'https://www.bseindia.com/stock-share-price/' || s || '/', 'BSE Corporate Filings for ' || s, 'source_page', 0.8, false FROM t WHERE k < 2""",
    "text_ranked_candidates": f"WITH {_CANDIDATES} SELECT source_name, document_type, document_url, title, round(rk.confidence, 6) AS confidence, round(max(rank_score), 6) AS rank_score, count(*) AS n FROM rk GROUP BY source_name, document_type, document_url, title, rk.confidence",
    "text_discovered": f"""WITH {_CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker, document_url ORDER BY confidence DESC NULLS LAST, source_name, document_type, title NULLS FIRST) AS n FROM rk WHERE document_type <> 'news'),
        r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rank_score DESC, document_url) AS rank FROM o WHERE n = 1) SELECT ticker, CAST(rank AS INTEGER) AS rank, document_url, source_name, round(rank_score, 6) AS rank_score FROM r WHERE rank <= 5""",
    "text_context": f"""WITH {_CHUNKS}, x AS (SELECT customer, string_agg('[' || rank || '] (' || label || ')' || chr(10) || CASE WHEN length(t) > 1200 THEN regexp_replace(left(t, 1200), ' [^ ]*$', '') || ' ...' ELSE t END, chr(10) || chr(10) ORDER BY rank) AS c FROM cl GROUP BY customer)
        SELECT customer, CAST(length(c) AS INTEGER) AS n, md5(c) AS digest FROM x""",
    "text_cited": """SELECT o_orderkey, array_to_string(list_transform(list_filter(CASE WHEN o_orderkey % 9 = o_orderkey % 4 THEN [o_orderkey % 9] ELSE [o_orderkey % 9, o_orderkey % 4] END, lambda x: x BETWEEN 1 AND 6), lambda x: CAST(x AS VARCHAR)), ',') AS cited FROM orders""",
    "text_plain_answers": f"""WITH {_CHUNKS}, x AS (SELECT customer, 'No language model is active, so here is the most relevant evidence retrieved for: “{QUERY}”' || chr(10) || chr(10)
          || string_agg('[' || rank || '] ' || left(t0, 300) || CASE WHEN length(t0) > 300 THEN '...' ELSE '' END || chr(10) || '    — ' || label, chr(10) || chr(10) ORDER BY rank) AS a, list(label ORDER BY rank) AS ls FROM cl GROUP BY customer)
        SELECT customer, md5(a) AS digest, array_to_string(list_filter(ls, lambda v, i: list_position(ls, v) = i), ';') AS sources FROM x""",
    "text_briefs": f"""WITH {NEWS}, t AS ({" UNION ALL ".join(f"SELECT customer, '{n}' AS topic, news_id, text FROM news WHERE {_any('lower(text)', w)}" for n, w in D.TOPICS)})
        SELECT customer, topic, count(*) AS passages, left(arg_min(text, news_id), 200) || '...' AS evidence FROM t GROUP BY 1, 2""",
    "text_snapshots": """WITH s AS (SELECT s_suppkey, s_name, s_nationkey, list_transform(list_filter(range(1, 8), lambda i: (s_suppkey + i) % 3 = 0), lambda i: '- good ' || i || chr(10)) AS p, list_transform(list_filter(range(1, 8), lambda i: (s_suppkey + i) % 8 = 0), lambda i: '- bad ' || i || chr(10)) AS c FROM supplier)
        SELECT s_suppkey, s_name || ' Company Snapshot:' || chr(10) || CASE WHEN s_suppkey % 3 > 0 THEN 'Business Overview: About ' || s_name || chr(10) || chr(10) ELSE '' END || 'Key Metrics:' || chr(10) || '- Nation: ' || s_nationkey || chr(10) || '- Key: ' || s_suppkey || chr(10)
        || CASE WHEN len(p) > 0 THEN chr(10) || 'Key Strengths (Screener Pros):' || chr(10) || array_to_string(p, '') ELSE '' END || CASE WHEN len(c) > 0 THEN chr(10) || 'Key Concerns (Screener Cons):' || chr(10) || array_to_string(c, '') ELSE '' END
        || chr(10) || 'Peers: P1, P2, P3, P4, P5' || chr(10) AS text FROM s""",
    "text_scenarios": f"""WITH {NEWS}, {_events_sql()} SELECT news_id, event, {_scene(0)} AS base, {_scene(1)} AS upside, {_scene(2)} AS downside FROM s""",
    "text_first_json": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '{"a": [1], "b": {"a": ' || o_orderkey || '}}' END AS json FROM orders""",
    "records_factor_frame": "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(avg(CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 20) / 10 - 1 ELSE 0 END), 6) AS overall_sentiment_score, round(avg((o_orderkey % 10) / 10), 6) AS risk_score, 0.0::DOUBLE AS growth_score FROM orders GROUP BY 1",
    "search_answer": f"""WITH {NEWS}, {_BM}, k AS (SELECT news_id, 0.3::DOUBLE * bm / max(bm) OVER () AS s FROM b), t AS (SELECT * FROM k ORDER BY round(s, 9) DESC, news_id LIMIT 400),
        z AS (SELECT news_id, s + 0.1::DOUBLE * {_count('t', sorted(QUERY.split()))} + 0.05::DOUBLE * {_count('t', D.FINANCE_WORDS)} AS rerank_score FROM t JOIN d USING (news_id)) SELECT news_id, round(rerank_score, 6) AS rerank_score FROM z ORDER BY round(z.rerank_score, 9) DESC, news_id LIMIT 100""",
    "search_unscoped": f"WITH {NEWS} SELECT ticker, count(*) AS n FROM news GROUP BY 1",
    "search_index": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS length, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM v",
    "search_filtered": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q),
        t AS (SELECT * FROM k ORDER BY round(s, 9) DESC, vec_id LIMIT 15) SELECT vec_id, label, round(s, 6) AS score FROM t WHERE label = 0 ORDER BY round(t.s, 9) DESC, vec_id LIMIT 5""",
}
