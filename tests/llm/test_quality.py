"""Quality scores: statistics against plain Python, the fit against direct solutions, held-out rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.quality import (
    BINS, STATISTICS, Features, _tree_sum, document_statistics, fit, held_out, isotonic, quality_scores, ridge, statistics,
)



def test_statistics():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB3.# \n\té€") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    texts += ["one", " ", "a a a\na a a\na a a", "THE END.", "x" * 5000, "é", "a b"]
    got = statistics(pa.array([*texts, None, ""]))
    at = {name: got[:, i] for i, name in enumerate(STATISTICS)}
    assert got.shape == (len(texts) + 2, len(STATISTICS)) and not got[-2:].any() and np.isfinite(got).all()
    for i, t in enumerate(texts):
        if not t:
            continue
        b = t.encode()
        words = [w.encode() for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        n = max(1, len(words))
        assert np.isclose(at["log_words"][i], np.log1p(len(words)))
        assert np.isclose(at["word_bytes"][i], sum(map(len, words)) / n)
        assert np.isclose(at["longest_word"][i], np.log1p(max(map(len, words), default=0)))
        assert np.isclose(at["digits"][i], sum(48 <= c < 58 for c in b) / len(b))
        assert np.isclose(at["symbols"][i], sum(c == ord("#") for c in b) / len(b))
        assert np.isclose(at["sentence_ends"][i], sum(w[-1:] in (b".", b"!", b"?") for w in words) / n)
        assert np.isclose(at["capital_words"][i], sum(65 <= w[0] < 91 for w in words) / n)
        lines = t.split("\n")
        assert np.isclose(at["repeated_lines"][i], 1 - len(set(lines)) / len(lines))
        share = np.bincount(np.frombuffer(b, np.uint8)) / len(b)
        assert np.isclose(at["entropy"][i], -(share[share > 0] * np.log2(share[share > 0])).sum())
    # what a batch holds besides a text does not matter
    alone = np.concatenate([statistics(pa.array([t])) for t in texts])
    assert np.allclose(alone, got[: len(texts)])


def test_kernel_and_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    z = Features(np.zeros(5), np.ones(5), 40_000)(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 5))).max() < 0.03
    for seed in range(30):
        rng = np.random.default_rng(seed)
        rows = rng.integers(0, 4, 12).astype(float)
        ones = np.array([rng.integers(0, n + 1) for n in rows], float)
        if not rows.any():
            continue
        got, full = isotonic(ones, rows), np.flatnonzero(rows)
        # the least squares fit that rises: the largest of least means of runs
        for k, i in enumerate(full):
            want = max(min(ones[full[a : b + 1]].sum() / rows[full[a : b + 1]].sum() for b in range(k, len(full))) for a in range(k + 1))
            assert np.isclose(got[i], want)
        assert (np.diff(got) >= -1e-12).all()


def test_fit_and_scores(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        kind = i % 4  # neither capitals nor symbols alone are bad, but one without the other is
        words = [w.upper() if kind in (1, 3) else w for w in words]
        words = [w + "#" if kind in (2, 3) else w for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(kind in (0, 3))))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "LONG " * 200_000, "x"), (None, "no id", "x"), (3, "again", "x")]
    labels += [(3, None), (None, 1), (4, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score"]
    scores = got.collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    known = {r.doc_id: r.quality for r in labels.dropna().groupBy("doc_id").agg(F.max("quality").alias("quality")).collect()}
    held = [(r.score, known[r.doc_id]) for r in scores if r.held_out and r.doc_id in known]
    assert len(held) > 200 and sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97
    assert {r.held_out for r in scores if r.doc_id is None} == {True}
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, labels.filter("quality = 1")).collect()} == {0.5}

    # sums of tasks are those of the whole
    stats = document_statistics(docs.select("doc_id", "text").filter("doc_id < 900")).join(labels.filter("doc_id <> 3"), "doc_id")
    train = stats.select("statistics", F.col("quality").alias("label"), F.expr("pmod(xxhash64(doc_id), 2)").cast("int").alias("half"))
    all_ = train.collect()
    x, y = np.array([r.statistics for r in all_]), np.array([r.label for r in all_], float)
    n, total, squares = _tree_sum(train, lambda x, y, _: [np.array([len(x), y.sum()]), x.sum(0), (x**2).sum(0)])
    assert np.allclose(n, [len(x), y.sum()]) and np.allclose(total, x.sum(0)) and np.allclose(squares, (x**2).sum(0))
    z = Features(x.mean(0), x.std(0), 32)(x)
    extra = np.sqrt(1e-3 * len(z)) * np.eye(33)
    extra[-1, -1] = 0
    direct = np.linalg.lstsq(np.vstack([z, extra]), np.concatenate([y, np.zeros(33)]), rcond=None)[0]
    assert np.allclose(ridge(z.T @ z, z.T @ y, 1e-3), direct, atol=1e-5)
    assert fit(train.filter("half = 0")) is None and isinstance(fit(train), bytes) and BINS > 1000


def test_held_out(spark):
    import zlib

    rows = spark.range(300).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
