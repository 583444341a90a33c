"""Best-fit decreasing packing of token ids into fixed windows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, free_worker, slices, tasks_for_bytes
from .tokenize import END_ID, SLICE_BYTES, default_path, encoder

WINDOW = 4096
TASK_BYTES = 16 << 20  # text per packing task
BATCH_IDS = 4 << 20  # ids that a task packs at once; bounds its memory
OUT_ROWS = 256  # pieces handed over at once
RUN_WINDOWS = 64  # windows' worth of ids packed at once where an order is to be kept; bounds how far a piece can move
RUN_SLICE_BYTES = 4 << 20  # text encoded at once for such runs: workers there also hold what other stages left

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Segment tree over remaining capacities 0..window: finds the tightest window that still takes a piece."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity >= length, as (capacity, id), removed from the tree."""
        count, node = self.count, length + self.size
        while not count[node]:
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each length (all 1..window), and how many windows there are. Ties keep their order."""
    tree, number, offset, n = OpenWindows(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        capacity, number[i] = found or (window, n)
        n += found is None
        offset[i] = window - capacity
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], number[i])
    return number, offset, n


@dataclass
class _Pieces:
    window: int
    doc_id: list = field(default_factory=list)
    start: list = field(default_factory=list)
    length: list = field(default_factory=list)
    doc_tokens: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    total: int = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n, self.window):
            part = ids[start : start + self.window]
            self.doc_id.append(doc_id)
            self.start.append(start)
            self.length.append(len(part))
            self.doc_tokens.append(n)
            self.ids.append(part.tobytes())
        self.total += n

    def packed(self, first: int) -> tuple[pa.RecordBatch, int]:
        number, offset, n = best_fit_decreasing(self.length, self.window)
        # windows in the order of their first pieces
        seen: dict[int, int] = {}
        number = [seen.setdefault(x, len(seen)) for x in number]
        long = lambda x: pa.array(x, pa.int64())
        columns = [long(self.doc_id), long(self.start), long(self.length), long(self.doc_tokens), long([first + x for x in number]), long(offset), pa.array(self.ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), first + n


def pack(docs: DataFrame, tokenizer: str, *, slots: DataFrame | None = None, window: int = WINDOW, end_id: int = END_ID, task_bytes: int = TASK_BYTES, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """Pieces of all documents with their place in windows of `window` ids: SCHEMA, ids as little-endian uint32.

    Each task encodes its share of the documents, cuts overlong ones into full windows and packs the pieces,
    largest first, each into the tightest open window; nothing is shuffled, and at most BATCH_IDS ids (or one
    document) are held at once. A document keeps its end id, so null and empty texts give one piece of one id.
    Repeated rows are packed once each. Sequence ids are the task's number shifted by 32 bits plus a counter.
    An empty table gives no rows; columns other than doc_id and text are ignored.

    slots (doc_id, slot; one row per id) gives documents an order, null slots last, that sequence ids then follow:
    ranges of slots go to tasks, `run_windows` windows' worth of ids are packed at once in the order of slots, and the
    windows of a run are numbered by their least slot. So a piece comes at most a run before or after its place.
    """
    most = BATCH_IDS if slots is None else min(BATCH_IDS, run_windows * window)
    in_runs = slots is not None
    slice_bytes = RUN_SLICE_BYTES if in_runs else SLICE_BYTES

    def run(batches):
        table = encoder(tokenizer)
        first = TaskContext.get().partitionId() << 32
        pieces = _Pieces(window)
        for batch in (part for whole in batches for part in slices(whole, 1, slice_bytes)):
            flat, bounds = table.encode(batch.column(1), end_id)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                pieces.add(doc_id, flat[bounds[i] : bounds[i + 1]])
                if pieces.total >= most:
                    out, first = pieces.packed(first)
                    yield from (out.slice(i, OUT_ROWS) for i in range(0, out.num_rows, OUT_ROWS))
                    pieces = _Pieces(window)
        if pieces.total:
            out, first = pieces.packed(first)
            yield from (out.slice(i, OUT_ROWS) for i in range(0, out.num_rows, OUT_ROWS))
        if in_runs:
            del table
            free_worker()  # what was learnt is left to no idle worker beside those of other stages

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tasks = tasks_for_bytes(narrow, "text", task_bytes)
    if slots is None:
        return narrow.coalesce(tasks).mapInArrow(run, SCHEMA)
    placed = narrow.join(slots.select(F.col("doc_id").alias("_id"), "slot").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    order = [F.asc_nulls_last("slot"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("_hash")]
    dealt = placed.withColumn("_hash", F.xxhash64("text")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), default_path()))
