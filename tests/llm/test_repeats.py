"""Suffix sorting and removal of repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.induced_sorting import Disk, induced_sort, sort_in_memory
from tidemark.llm.passages import GRAM, _Words, segments
from tidemark.llm.repeats import _narrow, remove_repeats, repeated_starts


def _suffix(text, i):
    out = []
    while text[i]:
        out.append(text[i])
        i += 1
    return out


def _common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("how", ["memory", "induced", "recursive on disk"])
def test_sorting(tmp_path, how):
    rng = random.Random(1)
    for trial in range(120):
        letters, depth = rng.choice([1, 2, 3, 5, 200]), rng.choice([3, 8, 1000])
        parts = [[rng.randint(1, letters) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))]
        if trial % 2:
            parts += [parts[0], parts[0], parts[-1][3:] + parts[0]]
        text = np.array([c for p in parts for c in [*p, 0]], np.int32)
        disk = Disk(f"file://{tmp_path}/{trial}")
        if how == "memory":
            at, lcp = sort_in_memory(text, depth)
        else:
            small = how != "induced"
            at, lcp = induced_sort(text, depth, disk=disk, room=7 if small else 1 << 20, in_memory=2 if small else 1 << 20)
        disk.close()
        suffixes = {i: _suffix(text.tolist(), i) for i in range(len(text)) if text[i]}
        assert sorted(at.tolist()) == sorted(suffixes)
        for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), lcp[1:].tolist()):
            assert suffixes[a][:depth] <= suffixes[b][:depth]
            assert min(n, depth) == min(_common(suffixes[a], suffixes[b]), depth)


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,many", [(20, 6, 200), (20, 6, 1), (9, 4, 1)])
def test_removal(spark, length, gram, many):
    rng = random.Random(5)
    passages = ["".join(rng.choice("ab cé") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = [(rng.choice([i, i, None, 3]), "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 15)))]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 200), (102, "a" * 200), (103, "xy" * 90), *rows[:5]]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    got = remove_repeats(docs, length=length, gram=gram, many=many, room=50, shard_rows=20)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute(rows, length)


def test_nothing_to_remove(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = remove_repeats(spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string"))
    assert [r.n_removed for r in got.collect()] == [0, 0]


def test_rows_of_one_class_are_in_many_tasks(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(400))
    docs = spark.range(4000).repartition(8).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the classes are many
        starts = repeated_starts(_narrow(docs))
        sizes = starts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum(sizes) == starts.select("doc_id").distinct().count() == 4000
    assert max(sizes) < 2000


def shared_words(rows, words):
    texts = {}
    for doc_id, t in rows:
        texts[doc_id, t or ""] = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    holders = {}
    for owner, t in texts.items():
        for i in range(len(t) - words + 1):
            holders.setdefault(tuple(t[i : i + words]), set()).add(owner)
    out = []
    for doc_id, text in rows:
        t, hit = texts[doc_id, text or ""], set()
        for i in range(len(t) - words + 1):
            if len(holders[tuple(t[i : i + words])]) > 1:
                hit.update(range(i, i + words))
        out.append((doc_id, len(hit)))
    return sorted(out, key=str)


def test_words_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "é", "bc", " ", "\t", "\x0b\n"]) for _ in range(400)).encode() + b"y" * 90 + b" z"
    want = re.findall(rb"[^\x20\x09-\x0D]+", text)
    hashes = []
    for piece in (1 << 20, 40, 3):
        monkeypatch.setattr("tidemark.llm.passages.PIECE", piece)
        begins, ends, found = _Words(5).split(text)
        assert [text[a:b] for a, b in zip(begins, ends)] == want
        hashes.append(found.tolist())
    assert hashes[0] == hashes[1] == hashes[2] and len(set(hashes[0])) == len(set(want))


@pytest.mark.parametrize("words", [20, 12, 3])
def test_passages_of_words(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcé\x1f ") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(5, 40))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passages)[rng.randint(0, 4) :], [word() for _ in range(rng.randint(0, 9))]]) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, None]), "".join(w + rng.choice([" ", "\n\t", "  ", "\x0b"]) for p in parts for w in p)))
    once = " ".join(f"{i}q" for i in range(30))
    rows += [(100, None), (101, " \n "), (102, f"{once} {once}"), (103, "z " * 90), (104, "z " * 50), (105, "y" * 300 + " x" * 30), *rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, words=words)
    assert sorted([(r.doc_id, r.n_passage_words) for r in got.collect()], key=str) == shared_words(rows, words)
    shared, told = segments(_narrow(docs), words)
    assert shared.count() and (words < GRAM or told.filter("shared").count() and told.filter("not shared").count())


def test_passages_under_400_bytes_are_told(spark):
    rng = random.Random(3)
    text = lambda n: [f"{rng.randrange(10**4)}" for _ in range(n)]
    passage = text(60)  # of under 400 bytes, so that the contract removes nothing
    rows = [(i, " ".join(text(80) + (passage if i < 4 else []) + text(50))) for i in range(12)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_removed == 0 for r in got.values())
    assert [got[i].n_passage_words for i in range(12)] == [60] * 4 + [0] * 8
