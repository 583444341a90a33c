"""Passages of `words` words that another document holds as well.

A string of 400 bytes may have more words than a passage that is copied: passages of over 50 words are often shorter. Words
are `[^\\x20\\x09-\\x0D]+`, so the space between them does not matter.

1. Every start of `words` words is assigned to an anchor, the GRAM words of least hash in them, as bytes are in repeats.
   Anchors that one document holds alone drop out.
2. Segments of one anchor with equal words form a class. All starts in a class of two documents or more are shared.
3. Of anchors with several classes, all starts of the classes of one document, and those of one document of each other
   class, are told by the hashes of their words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PIECE, Grams, anchors_of, those
from .shared import dropped, written

WORDS = 51
GRAM = 8
ANCHORS = "key long, class long, doc_id long, crc int, low int, high int, begin int, end int"
STARTS = "hash long, owner long, doc_id long, crc int, at int, shared boolean"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Words(Grams):
    """Hashes of words, and of grams of them."""

    def __init__(self, words: int):
        super().__init__(PIECE + words)
        self.letters = Grams(2 * PIECE)

    def of(self, data: np.ndarray, gram: int) -> np.ndarray:
        return self.of_values(data, gram)

    def split(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of each word."""
        out, begin = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))], 0
        while begin < len(text):
            space = _SPACE.search(text, min(begin + PIECE, len(text)))
            end = space.start() if space else len(text)
            data = np.frombuffer(text, np.uint8, end - begin, begin)
            if len(data) > len(self.letters.up):  # a word longer than a piece
                self.letters = Grams(len(data))
            letter = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
            steps = np.flatnonzero(letter[1:] != letter[:-1])
            first, last = steps[0::2], steps[1::2]
            out.append((first + begin, last + begin, self.letters.between(data, first, last)))
            begin = end
        return tuple(map(np.concatenate, zip(*out)))


def _anchors(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, text, crc. One row per anchor: low, high count words, begin, end bytes."""

    def run(batches):
        grams = _Words(words)
        for batch in batches:
            found, owners, sizes = [], [], []
            ids, crcs = batch.column(0), batch.column(2).to_numpy()
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                begins, ends, hashes = grams.split(text) if len(text) >= 2 * words - 1 else ((),) * 3
                if len(hashes) < words:
                    continue
                raw = hashes.tobytes()
                for key, at, low, high in anchors_of(hashes, grams, words, min(GRAM, words)):
                    same = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (b + words)], seed=c - a) for a, b, c in zip(low.tolist(), high.tolist(), at.tolist())]
                    found.append((key, np.array(same, np.uint64).view(np.int64), low, high, begins[low], ends[high + words - 1]))
                    owners.append(i)
                    sizes.append(len(key))
            if found:
                owner = np.repeat(owners, sizes)
                key, same, *places = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(same), ids.take(pa.array(owner)), pa.array(crcs[owner]), *(pa.array(x.astype(np.int32)) for x in places)], names=["key", "class", "doc_id", "crc", "low", "high", "begin", "end"])

    return docs.mapInArrow(run, ANCHORS)


def _held(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per key: its number n of rows, its least owner, and whether it has another."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("least"), (F.min("owner") != F.max("owner")).alias("shared"))


def _owner():
    return F.xxhash64("doc_id", "crc")


def segments(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(shared ranges doc_id, crc, low, high of starts; segments that are told by the hashes of their starts: key, class,
    shared, doc_id, crc, low in words, begin and end in bytes). docs: doc_id, text, crc, which together are a document."""
    rows = written(_anchors(docs, words), "passage-anchors")
    keys = written(_held(rows.select("key", _owner().alias("owner")), ["key"]).filter("shared").select("key", "n"), "passage-keys")
    found = written(those(rows, keys, ["key"]).drop("n"), "passage-segments").withColumn("owner", _owner())
    dropped(rows)
    classes = written(_held(found, ["key", "class"]), "passage-classes")
    shared = those(found, classes.filter("shared").select("key", "class", "n"), ["key", "class"]).select("doc_id", "crc", "low", "high")
    several = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n_classes")).filter("n_classes > 1"), "passage-several")
    contested = written(those(classes, several, ["key"], "n_classes").drop("n_classes"), "passage-contested")
    firsts = those(found, contested, ["key", "class"]).filter("owner = least")
    return shared, firsts.select("key", "class", "shared", "doc_id", "crc", "low", "begin", "end")


def told_by_hash(segments: DataFrame, words: int = WORDS) -> DataFrame:
    """Shared ranges (doc_id, crc, low, high) of starts in segments: doc_id, crc, at (its first word), bytes, shared."""

    def run(batches):
        grams, most = _Words(words), max(1, PIECE // (2 * words))  # a segment has under 2 * words of them
        for batch in batches:
            for rows in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                texts = rows.column(3).to_pylist()
                # all segments are split as one text; strings that reach over an end are left out
                begins, _, hashes = grams.split(b" ".join(texts))
                cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
                first = np.searchsorted(begins, cuts)
                starts = np.diff(first) - words + 1
                own = np.repeat(np.arange(len(texts)), starts)
                within = np.arange(len(own)) - np.repeat(np.cumsum(starts) - starts, starts)
                found = grams.of(hashes, words).view(np.int64)[first[own] + within]
                at = rows.column(2).to_numpy()[own] + within
                ids, crcs, shared, owners = (rows.column(i).take(pa.array(own)) for i in (0, 1, 4, 5))
                yield pa.RecordBatch.from_arrays([pa.array(found), owners, ids, crcs, pa.array(at.astype(np.int32)), shared], names=["hash", "owner", "doc_id", "crc", "at", "shared"])

    starts = segments.select("doc_id", "crc", "at", "bytes", "shared", _owner().alias("owner")).mapInArrow(run, STARTS)
    held = starts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("a"), F.max("owner").alias("b"), F.max("shared").alias("s"))
    hashes = written(held.filter("a <> b or s").select("hash", "n"), "passage-hashes")
    return those(starts.filter("not shared"), hashes, ["hash"]).select("doc_id", "crc", F.col("at").alias("low"), F.col("at").alias("high"))


def words_covered(ranges: list, words: int) -> int:
    """Words of the strings that start in ranges."""
    n = end = 0
    for low, high in sorted((r["low"], r["high"] + words) for r in ranges):
        n += max(0, high - max(low, end))
        end = max(end, high)
    return n
