"""Suffix-array dedup: removes bytes covered by a string of `length` bytes that also starts anywhere else.

1. Every start of a `length`-byte string is assigned to an anchor: the `gram` bytes of least hash inside that string.
   Equal strings have equal anchors, so only anchors whose bytes occur twice matter. Starts with one anchor form
   a range; its bytes are a segment.
2. Segments of one anchor with equal bytes form a class. All starts in a class of two or more are repeats; one
   segment stands for it against other classes of the anchor.
3. An anchor with many classes is divided by longer grams (half the range each time, at last the string itself),
   so that no group stays large.
4. Segments of anchors with two classes or more are dealt out by anchor. Each task joins its own into one text, sorts
   the suffixes by external induced sorting and reads the repeats off the common prefixes.
5. Repeated ranges go back to their documents, whose covered bytes are cut out.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .anchors import PIECE, Grams, anchors_of, those
from .induced_sorting import Disk, from_largest
from .shared import documents, dropped, new_folder, written

LENGTH = 400
GRAM = 128
MANY = 200  # classes of one anchor beyond which it is divided
SHARD_ROWS = 4_000  # segments sorted in one task, about
ROOM = 1 << 20  # tuples that a queue holds in memory
IN_MEMORY = 2 << 20  # names that are sorted at once; more of them are sorted by induction again
ANCHORS = "key long, class long, doc_id long, crc int, low int, high int, at int"
SEGMENTS = "key long, class long, doc_id long, crc int, low int, high int, at int, near int, far int, bytes binary"


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: doc_id, text, crc. One row per anchor of every text of at least `length` bytes."""

    def run(batches):
        grams = Grams(PIECE + length)
        for batch in batches:
            found, owners, sizes = [], [], []
            ids, crcs = batch.column(0), batch.column(2).to_numpy()
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                if len(text) < length:
                    continue
                for key, at, low, high in anchors_of(np.frombuffer(text, np.uint8), grams, length, gram):
                    same = [xxhash.xxh3_64_intdigest(text[a : b + length], seed=c - a) for a, b, c in zip(low.tolist(), high.tolist(), at.tolist())]
                    found.append((key, np.array(same, np.uint64).view(np.int64), low, high, at))
                    owners.append(i)
                    sizes.append(len(key))
            if found:
                owner = np.repeat(owners, sizes)
                key, same, low, high, at = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(same), ids.take(pa.array(owner)), pa.array(crcs[owner]), *(pa.array(x.astype(np.int32)) for x in (low, high, at))], names=["key", "class", "doc_id", "crc", "low", "high", "at"])

    return docs.mapInArrow(run, ANCHORS)


def _classes(rows: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """(repeated ranges; the first segment of each class whose anchor has other classes, with their number `n_classes`)."""
    repeated = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-anchors")
    found = written(those(rows, repeated, ["key"]).drop("n"), "segments")
    first = F.min(F.struct(F.hash("doc_id", "low").alias("h"), "doc_id", "crc", "low", "high", "at", *extra)).alias("first")
    classes = written(found.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), first), "classes")
    shared = written(classes.filter("n > 1").select("key", "class", "n"), "shared-classes")
    spans = those(found, shared, ["key", "class"]).select("doc_id", "crc", "low", "high")
    contested = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n_classes")).filter("n_classes > 1"), "contested-anchors")
    firsts = those(classes, contested, ["key"], "n_classes").select("key", "class", "n_classes", *(f"first.{c}" for c in ("doc_id", "crc", "low", "high", "at", *extra)))
    return spans, firsts


def _with_bytes(docs: DataFrame, firsts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments with their bytes. The ranges of a document come together; there are fewer than it has bytes."""
    per_doc = firsts.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("key", "class", "low", "high", "at", "n_classes")).alias("ranges"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "d", "crc": "c"})
    whole = docs.join(per_doc, docs.doc_id.eqNullSafe(F.col("d")) & (docs.crc == F.col("c"))).select("doc_id", "crc", "text", "ranges")
    each = whole.select("doc_id", "crc", F.col("text").cast("binary").alias("b"), F.explode("ranges").alias("r"))
    return each.select("r.key", "r.class", "doc_id", "crc", "r.low", "r.high", "r.at", F.lit(0).alias("near"), F.lit(length - gram).alias("far"), F.expr(f"substring(b, r.low + 1, r.high - r.low + {length})").alias("bytes"), "r.n_classes")


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Each segment as two, by the distance of the anchor from the start: near..mid and mid+1..far. Their key is the
    hash of the bytes that all starts at these distances have in common."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, doc_id, crc, low, high, at, near, far, data in zip(*(c.to_pylist() for c in batch.columns)):
                mid = (near + far) // 2
                for x, y in ((near, mid), (mid + 1, far)):
                    a, b = max(low, at - y), min(high, at - x)
                    if a > b or x > y:
                        continue
                    key = xxhash.xxh3_64_intdigest(data[at - x - low : at - y + length - low], seed=(x << 32) + y)
                    own = data[a - low : b - low + length]
                    same = xxhash.xxh3_64_intdigest(own, seed=at - a)
                    out.append((key - (key >> 63 << 64), same - (same >> 63 << 64), doc_id, crc, a, b, at, x, y, own))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=batch.schema.names)

    return rows.mapInArrow(run, SEGMENTS)


def _sorted_repeats(segments: DataFrame, length: int, folder: str, room: int, shard_rows: int, in_memory: int) -> DataFrame:
    """Ranges of repeated starts, from the suffixes of each task's segments."""

    def run(batches):
        owners, ranges, texts = [], [], []
        for batch in batches:
            for doc_id, crc, low, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                owners.append((doc_id, crc))
                ranges.append((low, len(data)))
                texts.append(data)
        if not texts:
            return
        text = np.zeros(sum(map(len, texts)) + len(texts), np.int16)
        at = 0
        begins = np.empty(len(texts), np.int64)
        for i, data in enumerate(texts):
            begins[i] = at
            text[at : at + len(data)] = np.frombuffer(data, np.uint8)
            text[at : at + len(data)] += 1
            at += len(data) + 1
        del texts
        again = np.zeros(len(text) + 1, bool)
        disk = Disk(f"{folder}/{uuid.uuid4().hex}")
        try:
            before = len(text)
            for places, common in from_largest(text, length, disk=disk, room=room, in_memory=in_memory):
                hit = np.flatnonzero(common >= length)
                again[places[hit]] = True
                again[np.concatenate(([before], places))[hit]] = True
                before = int(places[-1])
        finally:
            disk.close()
        again[-1] = False
        steps = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8)))))
        first, last = steps[0::2], steps[1::2] - 1
        which = np.searchsorted(begins, first, "right") - 1
        lows = np.array([x for x, _ in ranges], np.int64)[which] - begins[which]
        yield pa.RecordBatch.from_arrays(
            [pa.array([owners[i][0] for i in which], pa.int64()), pa.array([owners[i][1] for i in which], pa.int32()), pa.array((first + lows).astype(np.int32)), pa.array((last + lows).astype(np.int32))],
            names=["doc_id", "crc", "low", "high"],
        )

    rows = segments.select("doc_id", "crc", "low", "bytes", "key")
    shards = max(1, -(-rows.count() // shard_rows))
    return rows.repartition(shards, "key").select("doc_id", "crc", "low", "bytes").mapInArrow(run, "doc_id long, crc int, low int, high int")


def repeated_starts(docs: DataFrame, **sizes: int) -> DataFrame:
    """Ranges (doc_id, crc, low, high) of byte positions where a repeated string of `length` bytes starts. docs: doc_id, text, crc."""
    return _repeated(docs, None, **sizes)[0]


def _repeated(docs: DataFrame, others: DataFrame | None, *, length: int = LENGTH, gram: int = GRAM, many: int = MANY, room: int = ROOM, shard_rows: int = SHARD_ROWS, in_memory: int = IN_MEMORY) -> tuple[DataFrame, DataFrame]:
    """(repeated_starts; the segments of passages in `others` with their bytes, which are fetched in the same pass over the texts)."""
    spark = docs.sparkSession
    found = written(anchors(docs, length, gram), "anchors")
    spans, firsts = _classes(found, [])
    dropped(found)
    if others is not None:  # told from the others by n_classes
        own = F.when(F.col("shared"), -1).otherwise(0).cast("long").alias("n_classes")
        firsts = firsts.unionByName(others.select("key", "class", own, "doc_id", "crc", F.col("begin").alias("low"), (F.col("end") - length).alias("high"), F.col("low").alias("at")))
    segments = written(_with_bytes(docs, firsts, length, gram), "contested-segments")
    small = segments.filter(F.col("n_classes").between(1, many)).drop("n_classes")
    large = segments.filter(F.col("n_classes") > many).drop("n_classes")
    while not large.isEmpty():
        more, firsts = _classes(written(_halved(large, length), "halves"), ["near", "far", "bytes"])
        spans = spans.unionByName(more)
        firsts = written(firsts, "contested-halves")
        small = small.unionByName(firsts.filter(F.col("n_classes") <= many).select(small.columns))
        large = firsts.filter(F.col("n_classes") > many).select(small.columns)
    small = written(small, "to-sort")
    spans = spans.unionByName(_sorted_repeats(small, length, new_folder(spark, "suffix-queues"), room, shard_rows, in_memory))
    return spans, segments.filter("n_classes < 1").withColumn("shared", F.col("n_classes") < 0)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, many: int = MANY, room: int = ROOM, shard_rows: int = SHARD_ROWS, in_memory: int = IN_MEMORY, words: int = passages.WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, removed (array of begin, end) and kept (the bytes left).

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in the same document too. Null
    texts count as empty; texts shorter than `length` lose nothing. Repeated rows are repeats of each other. Null and
    repeated doc_ids are allowed; columns other than doc_id and text are ignored. An empty table gives no rows.
    n_passage_words: words in strings of `words` words that another document holds as well, whatever their bytes and the space
    between them. They are counted only: nothing is removed for them. Rows of one doc_id and text are one document there.
    """
    docs = _narrow(docs)
    passed, others = passages.segments(docs, words)
    spans, others = _repeated(docs, others, length=length, gram=gram, many=many, room=room, shard_rows=shard_rows, in_memory=in_memory)
    spans = written(spans, "repeats").withColumn("in_words", F.lit(False))
    passed = written(passed.unionByName(passages.told_by_hash(others, words)), "passages").withColumn("in_words", F.lit(True))
    span = F.struct("low", "high")
    per_doc = spans.unionByName(passed).groupBy(F.col("doc_id").alias("d"), F.col("crc").alias("c")).agg(F.collect_set(F.when(~F.col("in_words"), span)).alias("ranges"), F.collect_set(F.when(F.col("in_words"), span)).alias("passed"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, ranges, passed in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.large_binary()), *batch.columns[2:]))):
                removed = []
                for low, high in sorted((r["low"], r["high"] + length) for r in ranges or ()):
                    if removed and low <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], high)
                    else:
                        removed.append([low, high])
                cuts = [0, *(x for r in removed for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((doc_id, len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), passages.words_covered(passed or (), words), removed, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "removed", "kept"])

    both = docs.join(per_doc, docs.doc_id.eqNullSafe(F.col("d")) & (docs.crc == F.col("c")), "left").select("doc_id", "text", "ranges", "passed")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, removed array<array<long>>, kept binary")


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir))
    # what is left as text; a character that was cut in two is replaced
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
