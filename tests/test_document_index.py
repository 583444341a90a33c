"""Ingest: what is read is one version of each ticker, whatever was repeated or failed."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.text import bm25
from tidemark.sources import document_index as index
from tidemark.sources import storage

ROWS = "doc_id long, source_file string, ticker string, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_ingest(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    long = "Revenue grew. " * 200
    first = docs(spark, [(1, "a.txt", "007", long), (2, "b.txt", "BBB", "Margins fell in the year."), (3, "c.txt", None, "Debt is low."), (4, "d.txt", "BBB", " \n "), (5, "e.txt", "BBB", None)])
    assert index.manifest(spark, path).count() == 0
    m = {r.ticker: r for r in index.ingest(first, path).collect()}
    assert set(m) == {"007", "BBB", "Unknown"} and m["BBB"].chunks == 1 and m["007"].chunks > 3
    before = {r.chunk_id: r.text for r in index.load(spark, path).collect()}
    assert len(before) == sum(r.chunks for r in m.values())
    # again: the same chunks, once
    again = index.ingest(first, path)
    assert {r.ticker: r.number for r in again.collect()} == dict.fromkeys(m, 2)
    assert {r.chunk_id: r.text for r in index.load(spark, path).collect()} == before and index.load(spark, path).count() == len(before)
    # one ticker anew, others stay
    index.ingest(docs(spark, [(9, "x.txt", "BBB", "A new report on margins.")]), path)
    now = {r.chunk_id: r.text for r in index.load(spark, path).collect()}
    assert now == {k: v for k, v in before.items() if not k.startswith("2_")} | {"9_0": "A new report on margins."}
    kept = {r.ticker: r.version for r in index.manifest(spark, path).collect()}
    assert kept["007"] == again.filter("ticker = '007'").first().version
    # a run that fails leaves what was there
    broken = first.withColumn("text", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        index.ingest(broken, path)
    with pytest.raises(ValueError, match="no text"):
        index.ingest(first.filter("doc_id = 4"), path)
    assert {r.chunk_id: r.text for r in index.load(spark, path).collect()} == now
    best = index.search(index.load(spark, path), "margins report", k=2).collect()
    assert best[0].chunk_id == "9_0" and best[0].score > best[1].score
    assert {r.ticker for r in index.search(index.load(spark, path), "margins", ticker="007").collect()} == {"007"}
    assert index.search(index.load(spark, path), "margins", ticker="none such", k=1).first().chunk_id == "9_0"


def test_tags(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tcs_annual_report_2024.txt").write_text("Sales rose.")
    (tmp_path / "in" / "notes.txt").write_text("Nothing.")
    files = storage.load_texts(spark, f"file://{tmp_path}/in").withColumn("doc_id", F.xxhash64("source_file"))
    tags = lambda **how: {r.source_file: r.ticker for r in index.chunked(files, **how).collect()}
    own = tags()
    assert own["notes.txt"] == "Unknown" and own["tcs_annual_report_2024.txt"] not in ("Unknown", None)
    assert set(tags(ticker="X").values()) == {"X"}
    assert tags(ticker="X", overwrite=False) == own | {"notes.txt": "X"}


def test_search_equals_plain_scores(spark):
    texts = ["alpha beta gamma", "beta beta delta", "gamma", "alpha alpha alpha", "nothing here"]
    stored = index.chunked(docs(spark, [(i, "f", "T", t) for i, t in enumerate(texts)]))
    got = {r.chunk_id: r.score for r in index.search(stored, "alpha beta", k=10).collect()}
    vectors = {r.chunk_id: r.unit for r in stored.collect()}
    asked = spark.range(1).select(index.asked(spark, "alpha beta").alias("u")).first().u
    near = {k: sum(a * b for a, b in zip(v, asked)) for k, v in vectors.items()}
    words = {r.chunk_id: r.bm25 for r in bm25(stored, "alpha beta", key="chunk_id").collect()}
    words = {k: words.get(k, 0.0) for k in near}
    scale = lambda d: {k: (v - min(d.values())) / (max(d.values()) - min(d.values())) for k, v in d.items()}
    want = {k: 0.7 * scale(near)[k] + 0.3 * scale(words)[k] for k in near}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(sum(x * x for x in vectors["0_0"]) - 1) < 1e-12
