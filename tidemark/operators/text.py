"""Sentiment, news impact, factor scores, chunks and retrieval over texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.windows import ratio

BM25_K1, BM25_B = 1.5, 0.75
SLICE = 4 << 20  # characters of chunks that leave a task together


def _one_of(words) -> Column:
    return F.array(*map(F.lit, words))


def _hits(words: Column, of) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*of)))


def sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """pos, neg, score (their difference over their sum, 0 without any) and label (beyond 0.15 either way)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    out = df.withColumn("_w", words).withColumns({"pos": _hits(F.col("_w"), L.POSITIVE), "neg": _hits(F.col("_w"), L.NEGATIVE)}).drop("_w")
    exact = F.coalesce(F.try_divide((F.col("pos") - F.col("neg")).cast("double"), (F.col("pos") + F.col("neg")).cast("double")), F.lit(0.0))
    return out.withColumns({"score": F.bround(exact, 3), "label": F.when(exact > 0.15, "positive").when(exact < -0.15, "negative").otherwise("neutral")})


def overall_sentiment(scored: DataFrame, by: str, order: str | None = None) -> DataFrame:
    """Mean score of each group, how many of each label, and the group's own label (beyond 0.1).

    With `order`, a column without equal values, scores are added in its order: sums of doubles depend on it, and where a mean lies
    on a bound or between two decimals, so does the result.
    """
    if order:
        so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        scored = scored.withColumn("_sum", F.sum("score").over(so_far))
        mean = F.max_by("_sum", order) / F.count("score")
    else:
        mean = F.avg("score")
    out = scored.groupBy(by).agg(mean.alias("score"), *[F.count_if(F.col("label") == x).alias(x) for x in ("positive", "neutral", "negative")], F.count(F.lit(1)).alias("n"))
    return out.withColumn("label", F.when(F.col("score") > 0.1, "Bullish").when(F.col("score") < -0.1, "Bearish").otherwise("Neutral"))


def news_impact(df: DataFrame, symbol: str, text: str = "text", related: str | None = None) -> DataFrame:
    """Kind of event, materiality, relevance for a symbol, confidence, causality and direction of each text."""
    df = sentiment(df, text)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)))
    df = df.withColumn("_w", words)
    kinds = F.array(*[F.struct(F.size(F.array_intersect("_w", _one_of(terms))).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"), F.lit(weight).alias("weight")) for i, (name, weight, terms) in enumerate(L.EVENTS)])
    best = F.array_max(F.filter(kinds, lambda k: k["hits"] > 0))
    base = symbol.split(".")[0].upper()
    tags = F.transform(F.col(related), F.upper) if related else F.array().cast("array<string>")
    tagged = F.array_contains(tags, symbol) | F.array_contains(tags, base)
    named = F.upper(F.col(text)).rlike(f"(?<![A-Z0-9]){base}(?![A-Z0-9])")
    df = df.withColumns({"_best": best, "impact_hits": F.size(F.array_intersect("_w", _one_of(L.HIGH_IMPACT)))})
    df = df.withColumns({
        "event": F.coalesce("_best.name", F.lit(L.OTHER_EVENT[0])),
        "materiality": F.least(F.lit(99), F.coalesce("_best.weight", F.lit(L.OTHER_EVENT[1])) + F.least(F.lit(12), F.col("impact_hits") * 5)),
        "relevance": F.when(tagged, "PROVIDER-TAGGED").when(named, "DIRECT MENTION").when(F.size(tags) > 0, "CO-MENTIONED").otherwise("ASSOCIATION UNVERIFIED"),
    })
    weight = F.when(F.col("relevance") == "PROVIDER-TAGGED", 0.96).when(F.col("relevance") == "DIRECT MENTION", 0.76).when(F.col("relevance") == "CO-MENTIONED", 0.48).otherwise(0.24)
    score = F.col("score")
    return df.withColumns({
        "confidence": F.least(F.lit(0.98), weight * (0.72 + F.least(F.col("materiality"), F.lit(90)) / 300)),
        "causality": F.when((F.col("relevance") == "PROVIDER-TAGGED") & (F.col("materiality") >= 60) & (F.abs(score) >= 0.15), "LIKELY DRIVER").when(F.col("relevance").isin("PROVIDER-TAGGED", "DIRECT MENTION"), "RELEVANT CATALYST").otherwise("CO-MENTIONED · NOT CAUSAL"),
        "direction": F.when(score > 0.12, "POSITIVE SENSITIVITY").when(score < -0.12, "NEGATIVE SENSITIVITY").otherwise("TWO-SIDED"),
    }).drop("_w", "_best", "impact_hits")


def factor_scores(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Rule scores per group: steps for each text, kept within -1..1 (risks: 0..1)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = lambda phrases: sum((low.contains(p).cast("int") for p in phrases), F.lit(0))
    rows = df.filter(low != "").withColumns({"p": count(L.GOOD_NEWS), "n": count(L.BAD_NEWS)})
    up, down = (F.col("p") > F.col("n")).cast("double"), (F.col("n") > F.col("p")).cast("double")
    cash = F.when(low.contains("cash flow") & low.contains("strong"), 0.3).when(low.contains("cash flow") & low.contains("weak"), -0.3).otherwise(0.0)
    limit = lambda c, least: F.least(F.greatest(c, F.lit(float(least))), F.lit(1.0))
    return rows.groupBy(by).agg(
        limit(F.sum(0.2 * up - 0.2 * down), -1).alias("sentiment"), limit(F.sum(0.2 * down), 0).alias("risk"), limit(F.sum(0.2 * up - 0.1 * down), -1).alias("growth"),
        *[limit(F.sum(0.3 * (count(v) > 0).cast("double")), 0).alias(k) for k, v in L.FACTORS.items()],
        limit(F.sum(0.2 * up - 0.2 * down), -1).alias("management_tone"), limit(F.sum(cash), -1).alias("cash_flow_quality"), limit(F.sum(0.2 * (low.contains("regulat") | low.contains("compliance")).cast("double")), 0).alias("regulatory_risk"), F.count(F.lit(1)).alias("n"),
    )


def plain_text(html: Column, longest: int | None = None) -> Column:
    """Text of a page: scripts and styles out, tags to blanks, blanks together; cut at `longest` characters if that is given."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    whole = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return whole if longest is None else F.substring(whole, 1, longest)


def tidy(text: Column) -> Column:
    """Blanks together, runs of empty lines to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def _cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if at + size < len(text):
            stop = max(text.rfind(". ", at, end), text.rfind("\n", at, end))
            if stop > at + size // 2:
                end = stop + 1
        out.append((at, end))
        step = end - overlap
        at = step if at < step and overlap < end - at and at + size < len(text) else end
    return out


def chunks(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 800, overlap: int = 150, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_index, start, chunk, and texts to keep with them): overlapping pieces that end after a sentence or line where one ends in
    their second half.

    Null texts have none. Each batch is cut by itself, so nothing is shuffled; pieces leave the task in slices of SLICE characters,
    however long a batch's texts are.
    """
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.string() for _ in keep])
    names = ["key", "chunk_index", "start", "chunk", *[f"_keep{i}" for i in range(len(keep))]]

    def run(batches):
        slice_ = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        for batch in batches:
            out, held = [], 0
            # a row at a time: the batch isn't copied into Python as a whole
            for row in range(batch.num_rows):
                k, t, *kept = (c[row].as_py() for c in batch.columns)
                for i, (a, b) in enumerate(_cuts(t or "", size, overlap)):
                    out.append((k, i, a, t[a:b].strip(), *kept))
                    held += b - a
                    if held >= SLICE:
                        yield slice_(out)
                        out, held = [], 0
            if out:
                yield slice_(out)

    schema = "key long, chunk_index int, start int, chunk string" + "".join(f", _keep{i} string" for i in range(len(keep)))
    cut = df.select(F.col(key).cast("long"), tidy(F.col(text)), *[F.col(c).cast("string") for c in keep]).mapInArrow(run, schema)
    return cut.withColumnsRenamed({"key": key, **{f"_keep{i}": c for i, c in enumerate(keep)}}).filter("chunk <> ''")


def bm25(df: DataFrame, query: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bm25) for texts that hold a word of the query; words are cut at blanks. Rare words weigh ln((N - df + .5) / (df + .5) + 1).

    Only the query's words are exploded; document counts and mean length come from one pass.
    """
    terms = sorted(set(query.lower().split()))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    rows = df.select(F.col(key), words.alias("w")).withColumn("len", F.size("w"))
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    found = rows.select(key, "len", F.explode(F.filter("w", lambda w: w.isin(*terms))).alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    each = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per word of the query
    joined = found.join(F.broadcast(each), "term").join(F.broadcast(corpus))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("mean")))
    return joined.groupBy(key).agg(F.sum(part).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query_id: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cosine) of all vectors with that of one row, which every task gets."""
    q = vectors.filter(F.col(key) == query_id).select(F.col(vector).alias("q")).limit(1)
    v = F.col(vector)
    return vectors.join(F.broadcast(q)).select(key, ratio(dot(v, F.col("q")), F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("q"), F.col("q")))).alias("cosine"))


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int = 5, weights=(0.7, 0.3)) -> DataFrame:
    """The k best by weighted scores, each stretched to 0..1 over all rows (a span of 0 counts as 1); (key, s) and (key, w)."""
    rows = semantic.join(keyword, "key", "full").fillna(0.0, ["s", "w"])
    ends = rows.agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0)
    score = weights[0] * (F.col("s") - F.col("s0")) / span("s0", "s1") + weights[1] * (F.col("w") - F.col("w0")) / span("w0", "w1")
    return rows.join(F.broadcast(ends)).select("key", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "key").limit(k)


def document_metadata(name: Column) -> dict[str, Column]:
    """Company, ticker, year, quarter and kind of a document by its file name."""
    n = F.lower(name)
    hint = ticker = F.lit("Unknown")
    for word, symbol in reversed(L.TICKER_HINTS):
        hint, ticker = F.when(n.contains(word), word.capitalize()).otherwise(hint), F.when(n.contains(word), symbol).otherwise(ticker)
    has = lambda *w: [n.contains(x) for x in w]
    annual, report, quarterly, result, earnings, transcript = has("annual", "report", "quarterly", "result", "earnings", "transcript")
    kind = F.when(annual & report, "annual_report").when(quarterly | result | (earnings & ~transcript), "quarterly_result")
    for a, b, label in (("presentation", "deck", "investor_presentation"), ("transcript", "call", "earnings_transcript"), ("news", "article", "news_article"), ("broker", "initiation", "brokerage_report"), ("sector", "industry", "sector_report")):
        kind = kind.when(n.contains(a) | n.contains(b), label)
    found = lambda p: F.coalesce(F.nullif(F.upper(F.regexp_extract(n, p, 1)), F.lit("")), F.lit("Unknown"))
    return {"company": hint, "ticker": ticker, "fiscal_year": found(r"(20[0-9]{2})"), "quarter": found("(q[1-4])"), "document_type": kind.otherwise("unknown")}


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
