"""Sketches, edits and neighbours against a plain version."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from tidemark.llm.fingerprints import fingerprints

signed = lambda x: x - (1 << 64) if x >> 63 else x


def _chain(hashes):
    s = 42
    for h in hashes:
        s = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=s)
    return signed(s)


def _sketch(text, words=5, scale=8):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower()) if x]
    h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in w]
    s = {_chain(h[i : i + words]) for i in range(len(h) - words + 1)} if len(h) >= words else ({_chain(h)} if h else set())
    return {x for x in s if x < -(1 << 63) + (1 << 64) // scale} | ({min(s)} if s else set())


def _plain(rows):
    rows = sorted([(d, t or "") for d, t in rows], key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text = lambda s: ",".join(f"{x & (1 << 64) - 1:016X}" for x in sorted(s))
    out = []
    for i, (d, t) in enumerate(rows):
        following, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        a, b, c = _sketch(t), _sketch(edited), _sketch(following)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,ranges", [(0, 512), (1, 512), (2, 3), (60, 3), (60, 512)])
def test_fingerprints(spark, n, ranges):
    rng = random.Random(n)
    rows = [(rng.choice([i, i, None, 5]), rng.choice([None, "", "a b", "Hello wörld " * 3, "é😀 " * 2000, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))])) for i in range(n)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, range int")
    got = sorted([tuple(r)[:7] for r in fingerprints(docs, ranges=ranges).collect()], key=str)
    want = _plain(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want):
        assert x[5:] == pytest.approx(y[5:])
