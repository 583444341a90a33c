"""What the methods promise beside their results: exact merges, recursion on disk, bounds that end a walk, pairs that are summed up."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.fingerprints import containment, fingerprints, merged, sketch
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.shared import slices
from tidemark.llm.token_counts import at_limits, length_histogram
from tidemark.llm.topk import Lists, top_k
from tidemark.llm.toxicity import BUCKETS, _Scorer, _terms, fit

from test_repeats import brute


def test_merged_sketches_are_those_of_the_whole(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for n, m in ((0, 0), (0, 9), (1, 1), (3, 2), (6, 40), (8, 3000), (60, 60)):
        a, b = words(n), words(m)
        rows.append((" ".join(a), " ".join(b), [*zip(*(a[i:] for i in range(5)))] or [tuple(a)] * bool(a), [*zip(*(b[i:] for i in range(5)))] or [tuple(b)] * bool(b)))
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "a string, b string")
    for scale in (2, 8):
        one, two = sketch(F.col("a"), scale=scale), sketch(F.col("b"), scale=scale)
        got = df.select(one.alias("one"), two.alias("two"), merged(one, two, scale=scale).alias("both"), containment(one, two, scale=scale).alias("share")).collect()
        limit = -(1 << 63) + (1 << 64) // scale
        for r in got:
            every = set(r.one) | set(r.two)
            under = {x for x in every if x < limit}
            assert r.both == sorted(under or ({min(every)} if every else set()))
            own = [x for x in r.one if x < limit]
            assert r.share == (1.0 if not r.one else len(set(own) & set(r.two)) / len(own) if own else None)


def test_short_texts_inside_long_ones(spark):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    rows = [(" ".join(long[i : i + rng.randint(5, 60)]), " ".join(long)) for i in range(0, 3900, 40)]
    df = spark.createDataFrame(rows, "a string, b string").select(containment(sketch(F.col("a")), sketch(F.col("b"))).alias("c"))
    values = [r.c for r in df.collect()]
    # a short text lies wholly in the long one or says nothing
    assert values.count(1.0) > 60 and all(v in (None, 1.0) for v in values)


def test_ranges_follow_the_ids(spark):
    docs = spark.createDataFrame([(i * i % 101, f"text {i}") for i in range(300)] + [(None, "none")], "doc_id long, text string")
    few, many = (sorted(map(str, fingerprints(docs, ranges=n).collect())) for n in (1, 40))
    assert few == many


@pytest.mark.parametrize("room,in_memory", [(1 << 20, 2), (40, 2), (40, 50)])
def test_removal_by_recursion_on_disk(spark, room, in_memory):
    rng = random.Random(11)
    passages = ["".join(rng.choice("abc") for _ in range(rng.randint(20, 70))) for _ in range(5)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 15)))]) for _ in range(rng.randint(0, 6)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, length=18, gram=6, room=room, shard_rows=1000, in_memory=in_memory)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute(rows, 18)


def test_the_bound_ends_the_walk():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-10, 10, (3000, 6))
    vectors[:, 0] = rng.permutation(3000) * 50
    lists = Lists(np.arange(3000), vectors)
    for q in ([3, 1, 0, 0, 0, -1], [-2, 0, 1, 0, 0, 0], [0] * 6, [1, 1, 1, 1, 1, 1]):
        query = np.array(q)
        places, scores, stopped = lists.best(7, query, 5)
        whole = sorted((-int(v @ query), i) for i, v in enumerate(vectors) if i != 7)[:5]
        assert [(int(-s), int(lists.ids[p])) for p, s in zip(places, scores)] == whole
        assert stopped == (q != [0] * 6)


def test_products_that_do_not_fit_are_refused(spark):
    big = spark.createDataFrame([(0, [1e16, 1e16]), (1, [1e16, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        top_k(big).collect()
    large = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in top_k(large).collect()] == [2**56 + 256 * 768]


def test_machine_is_the_sum_over_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(80)]
    rows, labels = [], []
    for i in range(900):
        # nasty alone and group alone are fine, both together are not; both with praise are fine again
        kind = i % 5
        text = [rng.choice(words) for _ in range(8)] + [["nasty", "group"], ["nasty"], ["group"], ["nasty", "group", "praised"], []][kind]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = _Scorer(fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    texts = pa.array([t for _, t in rows] + ["", None, "unknown"])
    got = scorer.scores(texts)
    doc, bucket = _terms(texts, scorer.place)
    assert bucket.max() < BUCKETS
    for i in range(0, len(texts), 37):
        kept = [scorer.table[scorer.place[b]] for b in bucket[doc == i]]
        z = scorer.bias + sum(k[0] for k in kept) + sum(float(a[2:] @ b[2:]) for n, a in enumerate(kept) for b in kept[:n])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
    assert np.mean((got[:900] >= 0.5) == np.array([y for _, y in labels])) >= 0.95


def test_counts_at_any_limit(spark):
    lengths = [1, 1, 4, 7, 7, 90]
    h = length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    for r in at_limits(h, [0, 3, 7, 50, 1000]).collect():
        assert r.docs_longer == sum(n > r.context_limit for n in lengths)
        assert r.tokens_kept == sum(min(n, r.context_limit) for n in lengths) and r.tokens_kept + r.tokens_lost == sum(lengths)


def test_slices_hold_every_row():
    rng = random.Random(6)
    texts = [None if rng.random() < 0.1 else "é" * rng.randint(0, 40) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["i", "t"]).slice(3, 190)
    parts = list(slices(batch, 1, 100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts[3:193]
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(slices(batch.slice(0, 0), 1, 100)) == []
