"""Toxicity scores by a factorization machine over hashed terms.

A term is a word (a run of letters, lower-cased) or the start of one. Terms are hashed into BUCKETS; a fit keeps the
buckets that tell the labels apart best and learns for each a weight and a vector of FACTORS numbers, so that a pair
of terms counts by the product of their vectors. Scoring adds up the vectors of a document's distinct words.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, free_worker, slices

BUCKETS = 1 << 20
FACTORS = 4
KEPT = 1024  # buckets with a weight
LEAST_GAIN = 20.0  # G statistic that a kept bucket has at least
FIT_ROWS = 12_000  # labelled documents that a fit uses at most: those of least hash
STEPS, RATE, DECAY = 300, 0.05, 2e-4
STARTS = (4, 5, 6, 7, 8)  # bytes of the word starts
WIDTH = 24  # bytes of a word that are hashed
SLICE_BYTES = 2 << 20  # text whose terms are taken at once


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(document, word) of the distinct words of each text, in pairs of numbers, and the words."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern(pc.replace_substring_regex(lower, r"\P{L}+", " "), " ")
    coded = pc.dictionary_encode(split.flatten())
    sizes = np.diff(split.offsets.to_numpy())
    pairs = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    return np.unique(pairs), coded.dictionary


def _buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word and of each of its starts; BUCKETS where it is too short for one."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    hashed, out = np.zeros(len(words), np.uint64), np.full((len(words), len(STARTS) + 1), BUCKETS, np.int64)
    bucket = lambda x: ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64) % BUCKETS
    for k in range(WIDTH):
        inside = lengths > k
        if not inside.any():
            break
        hashed[inside] = (hashed[inside] + data[offsets[:-1][inside] + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k + 1 in STARTS:
            out[inside, STARTS.index(k + 1)] = bucket(hashed[inside])
    full = lengths > 0
    out[full, -1] = bucket(hashed[full] + lengths[full].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def _terms(texts: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of a batch; only buckets whose place isn't negative, if place is given."""
    pairs, words = _words(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc, word = pairs // len(words), pairs % len(words)
    buckets = _buckets(words)[word]
    wanted = buckets < BUCKETS if place is None else place[buckets] >= 0
    pairs = np.unique(np.broadcast_to(doc[:, None], buckets.shape)[wanted] * (BUCKETS + 1) + buckets[wanted])
    return (pairs // (BUCKETS + 1)).astype(np.int32), (pairs % (BUCKETS + 1)).astype(np.int32)


def _gain(with_: np.ndarray, of: float, other: np.ndarray, of_other: float) -> np.ndarray:
    """G statistic of a term that `with_` of `of` rows of one label have, and `other` of `of_other` of the other."""
    total = of + of_other
    share = (with_ + other) / total
    out = np.zeros(len(with_))
    for n, rows in ((with_, of), (other, of_other)):
        for seen, expected in ((n, share * rows), (rows - n, (1 - share) * rows)):
            out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def fit_machine(sizes: np.ndarray, buckets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray] | None:
    """Bias, kept buckets, weights and factors; None without rows of both labels. buckets: those of the rows' terms, one row
    after the other, of which each has `sizes`."""
    y = labels.astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    doc = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    toxic = y[doc] > 0
    counts = np.stack([np.bincount(buckets[~toxic], minlength=BUCKETS), np.bincount(buckets[toxic], minlength=BUCKETS)])
    there = np.flatnonzero(counts.any(axis=0))
    gain = _gain(counts[1, there], y.sum(), counts[0, there], len(y) - y.sum())
    best = np.lexsort((there, -gain))[:KEPT]
    kept = np.sort(there[best[gain[best] >= LEAST_GAIN]])
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(y), len(kept)), np.float32)
    inside = place[buckets] >= 0
    x[doc[inside], place[buckets[inside]]] = 1
    del doc, toxic, counts, inside
    rng = np.random.default_rng(3)
    p = [np.float32(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(kept), np.float32), (rng.standard_normal((len(kept), FACTORS)) * 0.01).astype(np.float32)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, STEPS + 1):
        sums = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((sums**2).sum(1) - x @ (p[2] ** 2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gx = g @ x
        grads = [g.sum(), gx + DECAY * p[1], x.T @ (g[:, None] * sums) - gx[:, None] * p[2] + DECAY * p[2]]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            p[i] = (p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return {"bias": np.array([p[0]]), "kept": kept, "weights": p[1], "factors": p[2]}


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> bytes | None:
    """A machine fitted to at most `rows` labelled documents, those of least hash of doc_id, in one task.

    labels: doc_id, toxic. Null labels don't count; of repeated ones the largest does, of repeated documents the least
    text. The model is a few kilobytes; None without documents of both labels.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def terms(batches):
        free_worker()
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                doc, bucket = _terms(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "toxic", "terms"])

    def run(batches):
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches).sort_by("doc_id").combine_chunks()
            lists = table.column("terms").chunk(0)
            machine = fit_machine(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), table.column("toxic").to_numpy())
            if machine is not None:
                out = io.BytesIO()
                np.savez(out, **machine)
                yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})

    # terms are taken side by side; their numbers, of at most `rows` documents, meet in one task
    found = chosen.mapInArrow(terms, "doc_id long, toxic int, terms array<int>").repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found.model) if found else None


class _Scorer:
    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model))
        self.bias = float(m["bias"][0])
        self.place = np.full(BUCKETS + 1, -1)
        self.place[m["kept"]] = np.arange(len(m["kept"]))
        squares = (m["factors"] ** 2).sum(1)
        self.table = np.column_stack([m["weights"], squares, m["factors"]]).astype(np.float64)

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = _terms(texts, self.place)
        place = self.place[bucket]
        sums = np.zeros((len(texts), self.table.shape[1]))
        for k in range(sums.shape[1]):
            sums[:, k] = np.bincount(doc, self.table[place, k], len(texts))
        z = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(1) - sums[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_scores(docs: DataFrame, model: bytes | None) -> DataFrame:
    """docs with a column `toxicity` from 0 to 1, instead of one of that name if there is one: null and empty texts get the score
    of a text without terms; 0 without a model. Rows stay as they are, repeated ones too; long texts are read as a whole."""
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    held: list[_Scorer] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            free_worker()
            held.append(_Scorer(model))
        parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE_BYTES)
        return pa.array(np.concatenate([np.empty(0), *(held[0].scores(part.column(0)) for part in parts)]))

    return docs.withColumn("toxicity", score(F.col("text").cast("string")))


def held_out(column: str = "doc_id"):
    """True for the rows that no fit learns from: a fifth, by crc32 of doc_id as text. Null doc_ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def without_toxic(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """docs whose score is under the threshold, with their columns; the model is fitted to the labelled rows of all_docs that aren't held out."""
    # the row goes along as one column, so that no name can clash
    packed = docs.select(F.struct("*").alias("_row"), "text")
    scored = toxicity_scores(packed, fit(all_docs, labels.filter(~held_out())))
    return scored.filter(F.col("toxicity") < threshold).select("_row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    scored = toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
