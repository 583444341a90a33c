"""Each stage of the pipeline against a plain version on its own input; only the machine's weights are taken as they are."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_near_duplicates import _roots
from test_secrets import _plain
from test_topk_toxicity_mixing import _mixed_by_loop
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.mixing import BLOCK_BYTES, PERIOD, mixed
from tidemark.llm.shared import documents, written
from tidemark.llm.shingles import shingle_set, words_of
from tidemark.llm.tokenize import END_ID, default_path
from tidemark.llm.toxicity import _Scorer, _terms, fit, held_out

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that each stage got and gave, by name."""
    docs, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"plain-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_toxicity(spark):
    before = documents(spark, LARGER)
    after = corpus_pipeline.toxicity(spark, before, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    scorer, texts = _Scorer(fit(before, labels.filter(~held_out()))), _texts(before)
    kept = set()
    for d, t in texts.items():
        _, buckets = _terms(pa.array([t]), scorer.place)
        rows = [scorer.table[scorer.place[b]] for b in buckets]
        z = scorer.bias + sum(r[0] for r in rows) + sum(float(a[2:] @ b[2:]) for n, a in enumerate(rows) for b in rows[:n])
        if 1 / (1 + np.exp(-np.clip(z, -30, 30))) < 0.5:
            kept.add(d)
    assert _texts(after).keys() == kept and 0 < len(kept) < len(texts)


def test_near_duplicates(steps):
    before, after = map(_texts, steps["near_duplicates"])
    sets = {d: shingle_set(words_of(t), 5) for d, t in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    assert after == {d: t for d, t in before.items() if roots[d] == d} and len(after) < len(before)


def test_secrets(spark):
    docs = documents(spark, LARGER)
    before, after = _texts(docs), _texts(corpus_pipeline.secrets(spark, docs, LARGER))
    changed = 0
    for d, t in before.items():
        spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in _plain(t)[4].split(",") if s))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        assert after[d] == (out + t[at:] if spans else t)
        changed += bool(spans)
    assert before.keys() == after.keys() and changed


def test_mixing(steps):
    before, after = steps["mixing"]
    assert sorted(map(tuple, before.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    rows = [(r.doc_id, r.source, r.text) for r in after.collect()]
    got = sorted(map(tuple, mixed(after).collect()), key=str)
    assert got == _mixed_by_loop(rows, PERIOD, BLOCK_BYTES, None)


def test_packing(steps):
    before, after = steps["packing"]
    tokenizer, texts = Tokenizer.from_file(default_path()), _texts(before)
    whole = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID] for d, t in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in after.collect():
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(whole[r.doc_id]) and zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    ends = lambda parts: [a + n for a, n in sorted(parts)]
    assert pieces.keys() == whole.keys() and all(ends(p)[-1] == len(whole[d]) and [a for a, _ in sorted(p)] == [0, *ends(p)[:-1]] for d, p in pieces.items())
    assert all([a for a, _ in sorted(w)] == [0, *ends(w)[:-1]] and ends(w)[-1] <= 4096 for w in windows.values())
    # windows are numbered by their least slot
    slots, least = {r.doc_id: r.slot for r in mixed(before).collect()}, {}
    for r in after.collect():
        least[r.sequence_id] = min(slots[r.doc_id], least.get(r.sequence_id, slots[r.doc_id]))
    first = [slot for _, slot in sorted(least.items())]
    assert len(first) > 10 and first == sorted(first)
