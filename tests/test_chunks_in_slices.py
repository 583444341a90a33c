"""Chunks keep what belongs to their document, leave tasks in slices, and get unit vectors."""

import math

from pyspark.sql import functions as F

from tidemark.operators import text
from tidemark.sources import document_index as index


def test_chunks_in_small_slices_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{j % (i + 2)}." for j in range(40 * i)), f"f{i}") for i in range(12)], "doc_id long, text string, source_file string")
    rows = lambda: sorted(map(tuple, text.chunks(docs, size=100, overlap=20, keep=("source_file",)).collect()))
    want = rows()
    monkeypatch.setattr(text, "SLICE", 150)
    assert rows() == want
    assert all(r[4] == f"f{r[0]}" for r in want)
    assert [r[:4] for r in want] == sorted(map(tuple, text.chunks(docs, size=100, overlap=20).collect()))


def test_documents_are_chunked_without_a_join(spark):
    docs = spark.createDataFrame([(1, "growth of the year. " * 80, "a", "A"), (2, None, "b", "none")], "doc_id long, text string, source_file string, ticker string")
    made = index.chunked(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r.ticker, r.source_file) for r in made.collect()} == {("A", "a")}


def test_lengths_of_vectors_are_summed_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    made = rows.select(index.unit(F.col("v")).alias("u"))
    assert [r.u for r in made.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("double")).alias("v"))
    assert math.isclose(wide.select(text.dot(index.unit(F.col("v")), index.unit(F.col("v")))).first()[0], 1.0)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
