"""Encoding, packing, token files and length histograms against plain encoding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import best_fit_decreasing, digest, pack
from tidemark.llm.shared import new_folder
from tidemark.llm.token_counts import length_histogram, quantile, token_lengths
from tidemark.llm.token_files import Sequences, read_token_files, write_token_files
from tidemark.llm.tokenize import END_ID, Encoder, default_path

TEXTS = [None, "", " ", "Hello, world! it's the cat's 3rd day", "a\tb\n\nc  d\r\ne f", "İstanbul ΣΑΣ ǅ é é ́x", "日本語のテキスト 🙂🙂 👩‍👩", "<|endoftext|> x<|startoftext|>y", "don't 'll 're''s", "word " * 5000, "x" * 9000, "same same", "same same"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3 - 6, t, "other") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoding(plain):
    flat, bounds = Encoder(default_path()).encode(pa.array(TEXTS), END_ID)
    for i, t in enumerate(TEXTS):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == [*plain(t), END_ID]


def test_best_fit():
    number, offset, n = best_fit_decreasing([5, 7, 3, 10, 2, 2, 1], 10)
    held = defaultdict(int)
    for length, k in zip([5, 7, 3, 10, 2, 2, 1], number):
        held[k] += length
    assert n == 3 and set(held.values()) == {10}


def test_packing(spark, docs, plain):
    window = 64
    whole = {i * 3 - 6: [*plain(t), END_ID] for i, t in enumerate(TEXTS)}
    rows = digest(pack(docs, default_path(), window=window)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == _crc(ids[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in whole.items():
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(map(len, whole.values()))
    assert len(sequences) <= -(-total // window) + 2
    assert pack(docs.limit(0), default_path()).count() == 0


def test_token_files(spark, docs, plain):
    manifest = write_token_files(docs, new_folder(spark, "test-files"), default_path(), length=128)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = [*plain(t), END_ID]
        assert got[i * 3 - 6] == (at, len(ids), _crc(ids))
        at += len(ids)
    empty = write_token_files(docs.limit(0), new_folder(spark, "test-files"), default_path())
    assert read_token_files(empty).count() == 0


def test_sequences_by_number(spark, docs, plain):
    manifest = write_token_files(docs, new_folder(spark, "test-files"), default_path(), length=64)
    sequences = Sequences(manifest, 64)
    whole = [i for t in TEXTS for i in [*plain(t), END_ID]]
    assert len(sequences) >= len(whole) // 64
    parts = [sequences[k] for k in reversed(range(len(sequences)))][::-1]
    assert [i for ids, mask in parts for i, m in zip(ids.tolist(), mask.to_pylist()) if m] == whole
    assert all(len(ids) == len(mask) == 64 and not ids.flags.owndata for ids, mask in parts)
    with pytest.raises(IndexError):
        sequences[len(sequences)]


def test_repeated_ids(spark, plain):
    rows = [(5, "one"), (5, "two words"), (None, "three"), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = digest(pack(docs, default_path(), window=64)).collect()
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((d or -1, _crc([*plain(t), END_ID])) for d, t in rows)
    back = read_token_files(write_token_files(docs, new_folder(spark, "test-files"), default_path())).collect()
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in back) == sorted((d or -1, _crc([*plain(t), END_ID])) for d, t in rows)


def test_histogram(spark, docs, plain):
    lengths = [len(plain(t)) + 1 for t in TEXTS]
    h = length_histogram(token_lengths(docs, default_path(), end_ids=1))
    rows = h.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_total == sum(lengths) and r.tokens_kept == sum(min(x, r.n_tokens) for x in lengths)
    assert quantile(h, 0.5).first().n_tokens == sorted(lengths)[len(lengths) // 2]
    assert length_histogram(token_lengths(docs.limit(0), default_path())).count() == 0
