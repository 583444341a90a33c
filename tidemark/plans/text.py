"""Queries over texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.windows import rounded, rounded_product
from tidemark.operators import text as T
from tidemark.sources.bars import table
from tidemark.sources.news import NEWS, headlines

QUERY = "the of market risk growth"
COMPANIES = ("Reliance", "apple", "NVDA", "unnamed", "hdfc")
FILES = ("Annual-Report.pdf", "quarterly.pdf", "investor deck.pdf", "earnings_transcript.txt", "call.txt", "news.html", "initiation.pdf", "sector.pdf", "misc.doc")


def sentiment(spark, d):
    return T.sentiment(headlines(spark, d).select("news_id", "text")).drop("text").withColumn("score", rounded("score"))


def overall(spark, d):
    """Scores are added in the order in which orders are stored, whatever their keys: so does SQL on one thread."""
    news = headlines(spark, d, "place").select("place", "customer", "text")
    return T.overall_sentiment(T.sentiment(news), "customer", "place").withColumn("score", rounded_product("score"))


def impact(spark, d):
    out = T.news_impact(headlines(spark, d), "ACME", related="related")
    return out.select("news_id", "event", "materiality", "relevance", rounded("confidence").alias("confidence"), "causality", "direction")


def factors(spark, d):
    out = T.factor_scores(headlines(spark, d).select("customer", "text"), "customer")
    return out.select(*[rounded(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


def pages(spark, d):
    t = T.plain_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.md5(t.cast("binary")).alias("digest"))


def chunks(spark, d):
    return T.chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", "start", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def bm25(spark, d):
    return T.bm25(table(spark, d, "documents"), QUERY).withColumn("bm25", rounded("bm25"))


def cosine(spark, d):
    """The ten vectors closest to the first."""
    return T.cosine(table(spark, d, "embeddings"), 0).filter("vec_id <> 0").withColumn("cosine", rounded("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


def hybrid(spark, d):
    s = T.cosine(table(spark, d, "embeddings"), 0).select(F.col("vec_id").alias("key"), F.col("cosine").alias("s"))
    w = T.bm25(table(spark, d, "documents"), QUERY).select(F.col("doc_id").alias("key"), F.col("bm25").alias("w"))
    return T.hybrid(s, w, 20).withColumn("score", rounded("score"))


def metadata(spark, d):
    """File names made of parts."""
    k = F.col("p_partkey")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    name = F.concat_ws("_", pick(COMPANIES, k), pick(("FY2023", "20241231", "old"), k), pick(("Q1", "q3", "all"), k * 5 + 1), pick(FILES, k * 3 + F.col("p_size")))
    rows = table(spark, d, "part").withColumn("file", name)
    return rows.select("p_partkey", *[c.alias(k) for k, c in T.document_metadata(F.col("file")).items()])


def candidates(spark, d):
    """The first page of each url (half of them with an ending), and whether its extension is one of a document or none at all."""
    k = F.col("page_id")
    ending = F.when(k % 4 == 0, ".zip").when(k % 4 == 1, "/x.PDF?y=1").otherwise("")
    first = T.first_of(table(spark, d, "pages").select("page_id", F.concat("url", ending).alias("url")), "url", "page_id")
    ext = F.regexp_extract(F.lower("url"), r"\.([a-z0-9]{2,5})(?:\?.*)?$", 1)
    return first.select("page_id", "url", (F.regexp_extract(F.lower("url"), r"^https?://[^/]+(/.*)?$", 1).rlike(r"\.(pdf|html|htm|txt|docx|csv)(\?.*)?$") | ~F.regexp_extract(F.lower("url"), r"^https?://[^/]+(/.*)?$", 1).rlike(r"\.[a-z0-9]{2,5}(\?.*)?$")).alias("allowed"), F.sha2(ext.cast("binary"), 256).alias("kind"))


_list = lambda words: ", ".join(f"'{w}'" for w in words)
_S = f"""w AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM {{t}}),
  h AS (SELECT *, CAST(len(list_filter(w, lambda x: x IN ({_list(L.POSITIVE)}))) AS INTEGER) AS pos, CAST(len(list_filter(w, lambda x: x IN ({_list(L.NEGATIVE)}))) AS INTEGER) AS neg FROM w),
  s AS (SELECT *, coalesce((pos - neg) / nullif(CAST(pos + neg AS DOUBLE), 0), 0) AS exact, round_even(exact, 3) AS score, CASE WHEN exact > 0.15 THEN 'positive' WHEN exact < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM h)"""
_KINDS = ", ".join(f"{{'hits': len(list_intersect(v, [{_list(t)}])), 'o': {-i}, 'name': '{n}', 'weight': {w}}}" for i, (n, w, t) in enumerate(L.EVENTS))
_has = lambda words: "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + ")"
_TERMS = sorted(set(QUERY.split()))
_BM = f"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
  f AS (SELECT doc_id, len(w) AS len, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM d, (VALUES {", ".join(f"('{t}')" for t in _TERMS)}) t(term)), g AS (SELECT * FROM f WHERE tf > 0),
  i AS (SELECT term, count(*) AS df FROM g GROUP BY term),
  b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS bm25 FROM g JOIN i USING (term), c GROUP BY doc_id)"""
_COS = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS cosine FROM embeddings, q)"
_PATH = "regexp_extract(lower(url), '^https?://[^/]+(/.*)?$', 1)"

QUERIES = {
    "text_sentiment": sentiment, "text_overall_sentiment": overall, "text_news_impact": impact, "text_factor_scores": factors, "text_pages": pages, "text_chunks": chunks,
    "search_bm25": bm25, "search_cosine": cosine, "search_hybrid": hybrid, "text_metadata": metadata, "text_candidates": candidates,
}

ORACLE_SQL = {
    "text_sentiment": f"WITH {NEWS}, {_S.format(t='news')} SELECT news_id, pos, neg, round(score, 6) AS score, label FROM s",
    "text_overall_sentiment": f"""WITH {NEWS}, {_S.format(t='news')}, g AS (SELECT customer, avg(score) AS m, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'neutral') AS neutral,
        count(*) FILTER (label = 'negative') AS negative, count(*) AS n FROM s GROUP BY customer) SELECT customer, round(m, 6) AS score, positive, neutral, negative, n, CASE WHEN m > 0.1 THEN 'Bullish' WHEN m < -0.1 THEN 'Bearish' ELSE 'Neutral' END AS label FROM g""",
    "text_news_impact": f"""WITH {NEWS}, {_S.format(t='news')}, v AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS v, list_transform(related, lambda x: upper(x)) AS tags FROM s),
        e AS (SELECT *, list_max(list_filter([{_KINDS}], lambda x: x.hits > 0)) AS best, len(list_intersect(v, [{_list(L.HIGH_IMPACT)}])) AS hi FROM v),
        m AS (SELECT *, coalesce(best.name, '{L.OTHER_EVENT[0]}') AS event, CAST(least(99, coalesce(best.weight, {L.OTHER_EVENT[1]}) + least(12, hi * 5)) AS INTEGER) AS materiality,
              CASE WHEN list_contains(tags, 'ACME') THEN 'PROVIDER-TAGGED' WHEN regexp_matches(upper(text), '(^|[^A-Z0-9])ACME($|[^A-Z0-9])') THEN 'DIRECT MENTION' WHEN len(tags) > 0 THEN 'CO-MENTIONED' ELSE 'ASSOCIATION UNVERIFIED' END AS relevance FROM e)
        SELECT news_id, event, materiality, relevance,
        round(least(0.98, CASE relevance WHEN 'PROVIDER-TAGGED' THEN 0.96 WHEN 'DIRECT MENTION' THEN 0.76 WHEN 'CO-MENTIONED' THEN 0.48 ELSE 0.24 END * (0.72 + least(materiality, 90) / 300.0)), 6)::DOUBLE AS confidence,
        CASE WHEN relevance = 'PROVIDER-TAGGED' AND materiality >= 60 AND abs(score) >= 0.15 THEN 'LIKELY DRIVER' WHEN relevance IN ('PROVIDER-TAGGED', 'DIRECT MENTION') THEN 'RELEVANT CATALYST' ELSE 'CO-MENTIONED · NOT CAUSAL' END AS causality,
        CASE WHEN score > 0.12 THEN 'POSITIVE SENSITIVITY' WHEN score < -0.12 THEN 'NEGATIVE SENSITIVITY' ELSE 'TWO-SIDED' END AS direction FROM m""",
    "text_factor_scores": f"""WITH {NEWS}, l AS (SELECT customer, lower(coalesce(text, '')) AS t FROM news), k AS (SELECT *, {_has(L.GOOD_NEWS)} AS p, {_has(L.BAD_NEWS)} AS n FROM l WHERE t <> ''),
        s AS (SELECT *, CAST(p > n AS INTEGER) AS up, CAST(n > p AS INTEGER) AS down FROM k)
        SELECT customer, round(least(greatest(sum(0.2 * up - 0.2 * down), -1.0), 1.0), 6)::DOUBLE AS sentiment, round(least(greatest(sum(0.2 * up - 0.2 * down), -1.0), 1.0), 6)::DOUBLE AS management_tone, round(least(greatest(sum(0.2 * down), 0.0), 1.0), 6)::DOUBLE AS risk, round(least(greatest(sum(0.2 * up - 0.1 * down), -1.0), 1.0), 6)::DOUBLE AS growth,
        {", ".join(f"round(least(greatest(sum(0.3 * CAST({_has(v)} > 0 AS INTEGER)), 0.0), 1.0), 6)::DOUBLE AS {k}" for k, v in L.FACTORS.items())},
        round(least(greatest(sum(CASE WHEN contains(t, 'cash flow') AND contains(t, 'strong') THEN 0.3 WHEN contains(t, 'cash flow') AND contains(t, 'weak') THEN -0.3 ELSE 0 END), -1.0), 1.0), 6)::DOUBLE AS cash_flow_quality,
        round(least(greatest(sum(0.2 * CAST(contains(t, 'regulat') OR contains(t, 'compliance') AS INTEGER)), 0.0), 1.0), 6)::DOUBLE AS regulatory_risk, count(*) AS n FROM s GROUP BY customer""",
    "text_pages": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)
        SELECT page_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS digest FROM t""",
    "search_bm25": f"WITH {_BM} SELECT doc_id, round(bm25, 6) AS bm25 FROM b",
    "search_cosine": f"WITH {_COS} SELECT vec_id, round(cosine, 6) AS cosine FROM k WHERE vec_id <> 0 ORDER BY round(cosine, 6) DESC, vec_id LIMIT 10",
    "search_hybrid": f"""WITH {_BM}, {_COS}, r AS (SELECT coalesce(vec_id, doc_id) AS key, coalesce(cosine, 0) AS s, coalesce(bm25, 0) AS w FROM k FULL JOIN b ON vec_id = doc_id),
        e AS (SELECT min(s) AS s0, max(s) - min(s) AS ds, min(w) AS w0, max(w) - min(w) AS dw FROM r), x AS (SELECT key, 0.7 * (s - s0) / CASE WHEN ds > 0 THEN ds ELSE 1 END + 0.3 * (w - w0) / CASE WHEN dw > 0 THEN dw ELSE 1 END AS score FROM r, e)
        SELECT key, round(score, 6) AS score FROM x ORDER BY round(x.score, 9) DESC, key LIMIT 20""",
    "text_metadata": f"""WITH f AS (SELECT p_partkey, lower(list_extract([{_list(COMPANIES)}], 1 + p_partkey % 5) || '_' || list_extract(['FY2023', '20241231', 'old'], 1 + p_partkey % 3) || '_' || list_extract(['Q1', 'q3', 'all'], 1 + (p_partkey * 5 + 1) % 3) || '_' || list_extract([{_list(FILES)}], 1 + (p_partkey * 3 + p_size) % 9)) AS n FROM part)
        SELECT p_partkey, CASE WHEN n LIKE 'reliance%' THEN 'RELIANCE.NS' WHEN n LIKE 'apple%' THEN 'AAPL' WHEN n LIKE 'nvda%' THEN 'NVDA' WHEN n LIKE 'hdfc%' THEN 'HDFCBANK.NS' ELSE 'Unknown' END AS ticker,
        CASE WHEN n LIKE 'reliance%' THEN 'Reliance' WHEN n LIKE 'apple%' THEN 'Apple' WHEN n LIKE 'nvda%' THEN 'Nvda' WHEN n LIKE 'hdfc%' THEN 'Hdfc' ELSE 'Unknown' END AS company,
        coalesce(nullif(regexp_extract(n, '(20[0-9]{{2}})', 1), ''), 'Unknown') AS fiscal_year, coalesce(nullif(upper(regexp_extract(n, '(q[1-4])', 1)), ''), 'Unknown') AS quarter,
        CASE WHEN n LIKE '%annual%' AND n LIKE '%report%' THEN 'annual_report' WHEN n LIKE '%quarterly%' OR n LIKE '%result%' OR (n LIKE '%earnings%' AND n NOT LIKE '%transcript%') THEN 'quarterly_result'
        WHEN n LIKE '%presentation%' OR n LIKE '%deck%' THEN 'investor_presentation' WHEN n LIKE '%transcript%' OR n LIKE '%call%' THEN 'earnings_transcript' WHEN n LIKE '%news%' OR n LIKE '%article%' THEN 'news_article'
        WHEN n LIKE '%broker%' OR n LIKE '%initiation%' THEN 'brokerage_report' WHEN n LIKE '%sector%' OR n LIKE '%industry%' THEN 'sector_report' ELSE 'unknown' END AS document_type FROM f""",
    "text_candidates": f"""WITH g AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '/x.PDF?y=1' ELSE '' END AS url FROM pages),
        f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM g)
        SELECT page_id, url, regexp_matches({_PATH}, '\\.(pdf|html|htm|txt|docx|csv)(\\?.*)?$') OR NOT regexp_matches({_PATH}, '\\.[a-z0-9]{{2,5}}(\\?.*)?$') AS allowed,
        sha256(regexp_extract(lower(url), '\\.([a-z0-9]{{2,5}})(?:\\?.*)?$', 1)) AS kind FROM f WHERE rn = 1""",
}
