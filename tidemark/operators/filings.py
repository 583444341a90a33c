"""Documents of companies: addresses, links, candidates, contexts with citations, briefs, and retrieval over an index."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text import dot

# Phrases that tell a financial document by its address or text.
FINANCIAL = (
    "annual report", "annual-report", "investor presentation", "earnings call", "transcript", "quarterly results", "financial results", "results presentation",
    "concall", "credit rating", "press release", "management discussion", "investor relations", "bse", "nse",
)
# Words that a rerank looks for, and what each is worth; so for each word of the query.
FINANCE_WORDS = (
    "revenue", "ebitda", "margin", "capex", "debt", "cash flow", "profit", "risk", "oil", "telecom", "retail", "growth", "regulation", "interest rate",
    "inflation", "currency", "crude", "refining", "subscriber", "arpu",
)
WORD_BONUS, QUERY_BONUS = 0.05, 0.1
# What candidates score by their source, kind and year.
SOURCE_POINTS, OTHER_POINTS = (("Official IR", 40), ("NSE", 35), ("BSE", 35), ("Screener", 25), ("Web Search", 15)), -5
KIND_POINTS = (("annual_report", 15), ("investor_presentation", 12), ("earnings_transcript", 10))
YEAR_POINTS = (("2024", "fy24", 10), ("2023", "fy23", 5))
# Topics of a brief and the phrases that tell them.
TOPICS = (
    ("growth", ("growth", "expansion", "increase in revenue")),
    ("risk", ("risk", "challenge", "decline", "threat")),
    ("margin", ("margin", "ebitda", "profitability")),
    ("capex", ("capex", "capital expenditure", "cash flow")),
    ("debt", ("debt", "leverage", "borrowing")),
    ("bull", ("competitive advantage", "market leader", "tailwinds")),
    ("bear", ("headwinds", "competition", "regulatory")),
)
# Scenario sentences by direction; {kpi} and {ticker} are filled in.
SCENARIOS = {
    "up": ("Evidence is constructive if the update produces measurable improvement in {kpi}.", "Upside: follow-through plus estimate upgrades makes the catalyst durable for {ticker}.",
           "Failure case: expectations rise faster than delivered fundamentals; the move mean-reverts."),
    "down": ("Evidence is adverse if the update causes estimate cuts or deterioration in {kpi}.", "Recovery case: the issue proves temporary, contained, or already reflected in consensus.",
             "Downside: second-order effects compound and force further de-rating in {ticker}."),
    "open": ("Direction is unresolved; confirmation must come from {kpi}.", "Upside: hard operating evidence resolves the ambiguity above current expectations.",
             "Downside: the narrative remains unconfirmed while positioning becomes crowded."),
}
# What each kind of event is measured by.
KPIS, OTHER_KPI = (
    ("EARNINGS / GUIDANCE", "Revenue growth · EPS · operating margin"),
    ("M&A / CAPITAL ALLOCATION", "FCF · leverage · share count · ROIC"),
    ("REGULATION / LEGAL", "Addressable market · opex · contingent liability"),
    ("PRODUCT / CUSTOMER", "Bookings · units · ARPU · market share"),
    ("SUPPLY CHAIN", "Gross margin · inventory days · delivery volume"),
    ("ANALYST / POSITIONING", "Consensus EPS · valuation multiple · short interest"),
    ("MACRO / MARKET", "WACC · FX translation · input cost · sector multiple"),
), "Consensus estimates · valuation multiple"
# Columns of a factor record besides date and ticker.
FACTOR_COLUMNS = ("overall_sentiment_score", "risk_score", "growth_score", "debt_risk_score", "capex_intensity_score", "margin_pressure_score", "cash_flow_quality_score", "management_tone_score", "regulatory_risk_score")


def document_id(source: Column, page: Column) -> Column:
    base = F.translate(source, " /\\", "___")
    return F.when(page.isNull(), base).otherwise(F.concat(base, F.lit("_p"), page.cast("string")))


def absolute_url(url: Column, base: Column) -> Column:
    """An address made absolute: those with a scheme as they are, others joined to base, empty without either. Dots in paths are resolved."""
    clean = F.regexp_replace(base, "[?#].*$", "")
    scheme, origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.substring(clean, F.length(origin) + 1, F.length(clean))
    tail = F.regexp_extract(url, "([?#].*)$", 1)
    own = F.regexp_replace(url, "[?#].*$", "")
    joined = F.when(own.startswith("/"), own).when(own == "", path).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), own))
    empty = F.array().cast("array<string>")
    drop = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    parts = F.aggregate(F.split(F.regexp_replace(joined, "^/", ""), "/", -1), empty, lambda a, p: F.when(p == "..", drop(a)).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    whole = F.concat(origin, F.lit("/"), F.array_join(parts, "/"), F.when(F.regexp_extract(joined, r"(/|^)\.{1,2}$", 0) != "", "/").otherwise(""), tail)
    out = F.when(F.coalesce(url, F.lit("")) == "", "").when(url.startswith("http"), url).when(F.coalesce(base, F.lit("")) == "", "").when(url.startswith("//"), F.concat(scheme, url)).otherwise(whole)
    return F.coalesce(out, F.lit(""))


def is_financial(url: Column, text: Column) -> Column:
    target = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))))
    return target.rlike("|".join(FINANCIAL))


def link_kind(url: Column, text: Column) -> Column:
    """The kind of document that a link leads to by its address and text, or null."""
    u, t = F.lower(url), F.lower(text)
    return (
        F.when(t.contains("annual report") | u.contains("annual-report"), "annual_report").when(t.contains("credit rating"), "credit_rating")
        .when(t.contains("concall") | t.contains("transcript"), "earnings_transcript").when(t.contains("investor presentation"), "investor_presentation")
        .when(u.contains("announcement"), "announcements").when(t.contains("results") & t.rlike("q[1-4]"), "quarterly_result")
    )


def links(pages: DataFrame, most: int = 20) -> DataFrame:
    """Of pages (page_id, url, html) the first `most` links that lead to documents: position, document_url, title, document_type, confidence, downloadable."""
    anchor = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("inner"))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("position", "a"))
    title = F.trim(F.regexp_replace(F.col("a.inner"), "<[^>]*>", ""))
    rows = rows.withColumns({"title": title, "document_type": link_kind(F.col("a.href"), title), "document_url": absolute_url(F.col("a.href"), F.col("url"))}).filter("document_type is not null")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= most)
    pdf = F.col("document_url").endswith(".pdf")
    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Screener Document ("), "document_type", F.lit(")")))
    return rows.select("page_id", "rank", "document_url", named.alias("title"), "document_type", F.when(pdf, 0.9).otherwise(0.8).alias("confidence"), (pdf | F.col("document_url").endswith(".txt") | F.col("document_url").endswith(".html")).alias("downloadable"))


def exchange_pages(tickers: DataFrame) -> DataFrame:
    """Pages of the two exchanges for Indian tickers: ticker, source_name, document_url, title, document_type, confidence, downloadable."""
    symbol = F.substring_index("ticker", ".", 1)
    page = lambda name, url, sure: F.struct(F.lit(name).alias("source_name"), url.alias("document_url"), F.concat(F.lit(f"{name} Corporate Filings for "), symbol).alias("title"), F.lit("source_page").alias("document_type"), F.lit(sure).alias("confidence"), F.lit(False).alias("downloadable"))
    nse = page("NSE", F.concat(F.lit("https://www.nseindia.com/get-quotes/equity?symbol="), symbol), 0.9)
    bse = page("BSE", F.concat(F.lit("https://www.bseindia.com/stock-share-price/"), symbol, F.lit("/")), 0.8)
    ns, bo = F.col("ticker").endswith(".NS"), F.col("ticker").endswith(".BO")
    return tickers.select("ticker", F.inline(F.filter(F.array(F.when(ns, nse), F.when(ns | bo, bse)), lambda x: x.isNotNull())))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (source_name, document_type, document_url, title, confidence) with rank_score: points by source, file, kind and year, times confidence (0.5 if missing)."""
    source, url, title = F.coalesce("source_name", F.lit("")), F.lower(F.coalesce("document_url", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    points = F.when(source.contains(SOURCE_POINTS[0][0]), SOURCE_POINTS[0][1])
    for name, n in SOURCE_POINTS[1:3]:
        points = points.when(source == name, n)
    for name, n in SOURCE_POINTS[3:]:
        points = points.when(source.contains(name), n)
    kind = F.when(F.col("document_type") == KIND_POINTS[0][0], KIND_POINTS[0][1])
    for name, n in KIND_POINTS[1:]:
        kind = kind.when(F.col("document_type") == name, n)
    names = lambda y, f: url.contains(y) | title.contains(y) | url.contains(f) | title.contains(f)
    year = F.when(names(*YEAR_POINTS[0][:2]), YEAR_POINTS[0][2]).when(names(*YEAR_POINTS[1][:2]), YEAR_POINTS[1][2]).otherwise(0)
    score = points.otherwise(OTHER_POINTS) + F.when(url.endswith(".pdf"), 20).otherwise(0) + kind.otherwise(0) + year
    return candidates.withColumn("rank_score", score * F.coalesce("confidence", F.lit(0.5)))


def discovered(sources: list[DataFrame], kinds: list[str], most: int = 25) -> DataFrame:
    """The best candidates of each ticker from all sources: of wanted kinds, each address once (the surest), ranked by score and address."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other)
    rows = rows.filter(F.col("document_type").isin(kinds) & (F.coalesce("document_url", F.lit("")) != ""))
    once = F.row_number().over(Window.partitionBy("ticker", "document_url").orderBy(F.desc("confidence"), "source_name", "document_type", "title"))
    rows = ranked_candidates(rows.withColumn("_n", once).filter("_n = 1").drop("_n"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("rank_score"), "document_url"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def _label(source: str, page: str) -> Column:
    return F.concat(F.coalesce(source, F.lit("Unknown")), F.lit(" (Page "), F.coalesce(F.col(page).cast("string"), F.lit("N/A")), F.lit(")"))


def numbered_context(chunks: DataFrame, key: str, most_characters: int = 1200) -> DataFrame:
    """Per key one text of its chunks (rank, text, source_file, page_number) in the order of rank, numbered, each cut at a word. A key has a few chunks."""
    text = F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, most_characters), " [^ ]*$", ""), F.lit(" ..."))
    rows = chunks.withColumn("_t", F.when(F.length(text) > most_characters, cut).otherwise(text))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), _label("source_file", "page_number"), F.lit(")\n"), F.col("_t"))
    each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return each.select(key, F.array_join(F.col("x.b"), "\n\n").alias("context"))


def cited(answer: Column, n: Column | int) -> Column:
    """The numbers in brackets of an answer that are 1 to n, each once, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.array_distinct(F.filter(found, lambda x: x.between(F.lit(1), n if isinstance(n, Column) else F.lit(n))))


# Fixed value: the first line of an answer that is the evidence itself.
NO_MODEL = "No language model is active, so here is the most relevant evidence retrieved for: “{}”"


def plain_answers(chunks: DataFrame, key: str, query: str) -> DataFrame:
    """Per key the evidence itself as an answer: its chunks in order, 300 characters of each with its source, and the different sources in order."""
    text = F.trim(F.coalesce("text", F.lit("")))
    snippet = F.concat(F.substring(text, 1, 300), F.when(F.length(text) > 300, "...").otherwise(""))
    label = _label("source_file", "page_number")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), snippet, F.lit("\n    — "), label)
    each = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l"), label.alias("s")))).alias("x"))
    first = F.lit(NO_MODEL.format(query))
    return each.select(key, F.concat_ws("\n\n", F.array(first), F.col("x.l")).alias("answer"), F.array_distinct("x.s").alias("sources"))


def briefs(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Per key and topic: how many texts speak of it, and the first 200 characters of the first one. Topics without any have no row."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in TOPICS]), lambda t: t.isNotNull())
    rows = chunks.select(key, F.col(order).alias("_o"), F.col(text).alias("_t"), F.explode(hits).alias("topic"))
    return rows.groupBy(key, "topic").agg(F.count(F.lit(1)).alias("passages"), F.concat(F.substring(F.min_by("_t", "_o"), 1, 200), F.lit("...")).alias("evidence"))


def snapshot_text(rows: DataFrame) -> DataFrame:
    """rows (name, about, metrics map, pros, cons, peers) with `summary`, a text of what is there."""
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    part = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(title), lines(c))).otherwise("")
    metrics = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.withColumn("summary", F.concat(
        F.col("name"), F.lit(" Company Snapshot:\n"), F.when(F.coalesce("about", F.lit("")) != "", F.concat(F.lit("Business Overview: "), F.col("about"), F.lit("\n\n"))).otherwise(""), F.lit("Key Metrics:\n"), lines(metrics),
        part(F.col("pros"), "\nKey Strengths (Screener Pros):\n"), part(F.col("cons"), "\nKey Concerns (Screener Cons):\n"),
        F.when(F.size("peers") > 0, F.concat(F.lit("\nPeers: "), F.array_join(F.slice("peers", 1, 5), ", "), F.lit("\n"))).otherwise(""),
    ))


def scenario_texts(rows: DataFrame, ticker: str) -> DataFrame:
    """rows (event, score) with base, upside and downside sentences for a ticker."""
    kpi = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KPIS for x in pair]), F.col("event")), F.lit(OTHER_KPI))
    which = lambda i: F.when(F.col("score") > 0.12, SCENARIOS["up"][i]).when(F.col("score") < -0.12, SCENARIOS["down"][i]).otherwise(SCENARIOS["open"][i])
    filled = lambda i: F.replace(F.replace(which(i), F.lit("{kpi}"), kpi), F.lit("{ticker}"), F.lit(ticker))
    return rows.withColumns({"base": filled(0), "upside": filled(1), "downside": filled(2)})


def _first_object(text: str | None) -> str | None:
    at = (text or "").find("{")
    depth = 0
    for i in range(at, len(text or "")) if at >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            try:
                return json.dumps(json.loads(text[at : i + 1]), sort_keys=True)
            except ValueError:
                return None
    return None


def first_json(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `json`: the first balanced object of a text, its keys sorted; null if there is none or it is no JSON."""

    @F.arrow_udf("string")
    def found(x: pa.Array) -> pa.Array:
        return pa.array([_first_object(t) for t in x.to_pylist()], pa.string())

    return rows.withColumn("json", found(F.col(text)))


def factor_frame(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(date, ticker, factors) of JSON records; missing factors are 0."""
    r = F.from_json(payload, "as_of_date string, ticker string, " + ", ".join(f"{c} double" for c in FACTOR_COLUMNS))
    return rows.select(r.alias("r")).select(F.col("r.as_of_date").try_cast("date").alias("date"), F.col("r.ticker").alias("ticker"), *[F.coalesce(F.col(f"r.{c}"), F.lit(0.0)).alias(c) for c in FACTOR_COLUMNS])


def reranked(rows: DataFrame, query: str, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The k best of rows (key, text, score) after a bonus for each word of the query and each finance word that a text holds."""
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    score = F.col("score") + QUERY_BONUS * count(sorted(set(query.lower().split()))) + WORD_BONUS * count(FINANCE_WORDS)
    return rows.withColumn("rerank_score", score).orderBy(F.desc(F.round("rerank_score", 9)), key).limit(k)


def scoped(rows: DataFrame, ticker: str) -> DataFrame:
    """The rows of a ticker, or all if it has none."""
    there = rows.agg(F.coalesce(F.bool_or(F.col("ticker") == ticker), F.lit(False)).alias("_there"))  # one row
    return rows.join(F.broadcast(there)).filter(~F.col("_there") | (F.col("ticker") == ticker)).drop("_there")


def index(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with `unit`: the vector at length 1, or as it is if its length is 0."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    return vectors.withColumn("_norm", norm).withColumn("unit", F.when(F.col("_norm") > 0, F.transform(v, lambda x: x / F.col("_norm"))).otherwise(v)).drop("_norm")


def save_index(indexed: DataFrame, path: str) -> None:
    indexed.write.mode("overwrite").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retrieved(indexed: DataFrame, query_id: int, k: int = 5, filters: dict | None = None, key: str = "vec_id") -> DataFrame:
    """The k best rows by inner product with one row's unit vector that match the filters, out of the 3 k best of all."""
    q = indexed.filter(F.col(key) == query_id).select(F.col("unit").alias("q")).limit(1)
    best = indexed.join(F.broadcast(q)).withColumn("score", dot(F.col("unit"), F.col("q"))).orderBy(F.desc(F.round("score", 9)), key).limit(3 * k)
    for name, value in (filters or {}).items():
        if value is not None:
            best = best.filter(F.col(name) == value)
    return best.orderBy(F.desc(F.round("score", 9)), key).limit(k).drop("q")
