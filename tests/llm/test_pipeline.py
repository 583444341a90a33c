"""The pipeline, stage by stage, and the guard that leaves the library whole without it."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.mixing import BLOCK_BYTES
from tidemark.llm.near_duplicates import near_duplicate_groups
from tidemark.llm.packing import RUN_WINDOWS, WINDOW
from tidemark.llm.shared import documents, written

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark):
    docs = documents(spark, SF)
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == columns
        if name in ("secrets", "mixing"):
            assert out.count() == docs.count()
        if name == "near_duplicates":
            assert near_duplicate_groups(out).filter("not kept").count() == 0
        docs = out
    assert 0 < docs.count() <= n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_windows_follow_the_mixed_order(spark, tmp_path):
    # a has two thirds of the bytes and the longest documents; by the square roots a, b, c have targets 2, 1, 1
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kinds = [("a", 4000)] * 160 + [("b", 400)] * 400 + [("c", 100)] * 1600
    rng.shuffle(kinds)
    rows = [(i, text(n), "en", s, 6 * n - 1) for i, (s, n) in enumerate(kinds)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7, "doc_id").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "doc_tokens", "sequence_id").collect()
    source, tokens = {r[0]: r[3] for r in rows}, Counter()
    assert {r.doc_id for r in got} == set(source)
    for r in got:
        tokens[source[r.doc_id]] += r.length
    block = BLOCK_BYTES * tokens.total() / sum(len(r[1]) for r in rows)
    so_far, windows, worst, whole = Counter(), defaultdict(list), 0.0, 0
    for r in got:
        windows[r.sequence_id].append(r)
    for _, pieces in sorted(windows.items()):
        for r in pieces:
            so_far[source[r.doc_id]] += r.length
        if max(so_far["b"] / tokens["b"], so_far["c"] / tokens["c"]) > 0.9:
            break
        whole += 1
        worst = max(worst, *(abs(so_far[s] - w * so_far.total()) for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.25))))
    # a block is the documents that begin in it, so its last one may stand out
    assert whole > 2 * RUN_WINDOWS and worst < block + max(r.doc_tokens for r in got)


def test_names_that_clash(spark):
    """Columns named as those that stages work with, and some with dots and spaces, come through every stage."""
    names = ["a.b", "a b", "text.x", "_row", "_id", "_own", "_slot", "slot", "toxicity", "component_id", "kept", "n_shingles", "a", "b"]
    names += ["bucket", "signature", "set_key", "spans", "start", "length", "sequence_id", "offset", "block", "share", "ids"]
    docs = documents(spark, SF).limit(60)
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r)[-len(names) :] for r in out.collect()} == {tuple(range(len(names)))}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_empty(spark):
    docs = documents(spark, SF).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_entry_without_a_session():
    code = "import re, __spark_entry__ as e; assert len([n for n in e.queries() if re.match('op[0-9]+_', n)]) == 13 and 'pipeline' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
