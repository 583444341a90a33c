"""Top-k search against all pairs, toxicity on held-out rows, mixing against a loop."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import SLOTS_EACH, in_mixed_order, mixed
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import fit, held_out, toxicity_scores, without_toxic


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=3)]) for i in range(150)]
    rows += [(200, None), (250, []), (300, [1.0, None, 2.0]), (350, [math.nan, 0.0, 0.0]), (400, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (450, [0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (7, rows[7][1]), *((600 + i, rows[50][1]) for i in range(8))]
    got = sorted(map(tuple, top_k(spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, rank int"), block=block).collect()))
    good = {i: [math.floor(float(np.float32(x)) * 256) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], e)), i) for i, e in good.items() if i != q and len(e) == len(good[q]))
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s[:5])]
    assert got == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        # only together are the two words toxic
        kind = i % 6
        text += [["nasty", "group"], ["nasty"], ["group"], [], ["idiot"], []][kind]
        rng.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(kind in (0, 4))))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "idiot " * 20000, "x"), (None, "fine", "x")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity_scores(docs.select("doc_id", "text"), fit(docs, labels.filter(~held_out()))).join(labels, "doc_id").filter(held_out())
    right = scored.select(F.avg(((F.col("toxicity") >= 0.5).cast("int") == F.col("toxic")).cast("double"))).first()[0]
    assert right >= 0.95
    kept = without_toxic(docs, docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {5000, 5001, None} <= ids and 5002 not in ids
    assert fit(docs, labels.limit(0)) is None and toxicity_scores(docs.select("doc_id", "text"), None).agg(F.max("toxicity")).first()[0] == 0.0
    assert without_toxic(docs.limit(0), docs, labels).count() == 0


def _mixed_by_loop(rows, period, block, weights):
    by = defaultdict(list)
    for d, s, t in rows:
        by[s].append((d, len((t or "").encode())))
    total = {s: sum(n for _, n in v) for s, v in by.items()}
    raw = {s: float(weights.get(s, 0)) if weights else max(1, b) ** 0.5 for s, b in total.items()}
    raw = {s: w for s, w in raw.items() if w > 0}
    name = lambda s: "-" if s is None else "+" + s
    exact = {s: w / sum(raw.values()) * (period - len(raw)) for s, w in raw.items()}
    share = {s: 1 + math.floor(e) for s, e in exact.items()}
    for s in sorted(exact, key=lambda s: (-round(exact[s] - math.floor(exact[s]), 9), name(s)))[: period - sum(share.values())]:
        share[s] += 1
    done, slot = dict.fromkeys(share, 0), {}
    for t in range(period):
        open_ = [(-(-(done[s] + 1) * period // share[s]), name(s), s) for s in share if done[s] < share[s] and done[s] * period // share[s] <= t]
        deadline, _, s = min(open_, key=lambda x: x[:2])
        assert t < deadline
        slot[s, done[s]], done[s] = t, done[s] + 1
        assert all(abs(done[s] - share[s] / period * (t + 1)) < 1 for s in share)
    out = []
    for s, v in by.items():
        at = 0
        for d, n in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0)):
            b, at = at // block, at + n
            a = share.get(s)
            out.append((d, s, n, b, *((b // a * period + slot[s, b % a], b * period // a, -(-(b + 1) * period // a)) if a else (None,) * 3)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,weights", [(0, None), (1, None), (300, None), (300, {"a": 3, "b": 1})])
def test_mixing(spark, n, weights):
    rng = random.Random(n)
    rows = [(i or None, rng.choice(["a", "a", "a", "b", "c", None, ""]), rng.choice([None, "", "é" * 9, "x" * rng.randint(1, 300)])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(map(tuple, mixed(docs, period=50, block_bytes=200, weights=weights, parts=5).collect()), key=str)
    assert got == (_mixed_by_loop(rows, 50, 200, weights) if n else [])


def test_mixing_of_many_sources(spark):
    # 1,199 sources of two documents, and one that has 30 % of the weight
    rows = [(i, f"s{i % 1199}", "x") for i in range(2398)] + [(i, "hot", "x" * 50) for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"hot": 0.3, **{f"s{i}": 0.7 / 1199 for i in range(1199)}}
    for how in ({"weights": weights}, {}, {"period": 1000}):
        got = mixed(docs, block_bytes=50, **how).collect()
        assert len(got) == len(rows) and all(0 <= r.release <= r.slot < r.deadline for r in got)
        assert len({r.slot for r in got if r.source == "hot"}) == 1000 == len({r.block for r in got if r.source == "hot"})
        if how == {"weights": weights}:
            last = max(r.slot for r in got if r.source == "hot")
            assert abs(1000 / (last + 1) - 0.3) < 0.3 / SLOTS_EACH + 0.002


def test_mixed_order(spark):
    rows = [(i % 90, "ab"[i % 3 == 0], "t" * 50, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot long")
    got = in_mixed_order(docs, period=10, block_bytes=100).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert len({r.source for r in got[:12]}) == 2
