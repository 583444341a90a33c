"""Token ids as Arrow files of fixed-size-list batches, with random access to equal-length sequences and masks."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, new_folder, slices, written
from .tokenize import END_ID, SLICE_BYTES, default_path, encoder

SEQUENCE = 2048  # ids per row of a file
BATCH_ROWS = 128  # rows per record batch

MANIFEST = "part long, ids_file string, docs_file string, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str, how: str):
    """A file by URI. Local ones are memory-mapped for reading, so that batches are not copied."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    if how == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Encode all documents into folder, in ascending doc_id order (nulls first, ties in any order), and return
    the manifest: one row per part in that order, naming its file of sequences and its file of documents.

    Ranges of doc_id go to tasks; each streams its documents into rows of `length` ids, holding one record
    batch at a time; only the last row of a part is padded (mask false). Ids take 16 bits if the vocabulary
    allows. File names are new for each attempt and only those in the manifest count, so a repeated task does
    no harm. Null and empty texts hold the end id alone; an empty table has an empty manifest.
    """

    def write(batches):
        table = encoder(tokenizer)
        wide = table.vocabulary > 1 << 16
        kind = "<u4" if wide else "<u2"
        name = f"{folder}/part-{uuid.uuid4().hex}"
        schema, index = sequence_schema(length, wide), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = n_tokens = 0
        held = np.empty(0, kind)
        sequences = documents_file = None

        def put(flat: np.ndarray) -> None:
            rows = -(-len(flat) // length)
            mask = np.zeros(rows * length, bool)
            mask[: len(flat)] = True
            ids = np.zeros(rows * length, kind)
            ids[: len(flat)] = flat
            sequences.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            if sequences is None:
                streams = [_open(f"{name}.ids.arrow", "w"), _open(f"{name}.docs.arrow", "w")]
                sequences, documents_file = pa.ipc.new_file(streams[0], schema), pa.ipc.new_file(streams[1], index)
            flat, bounds = table.encode(batch.column(1), end_id)
            sizes = np.diff(bounds)
            documents_file.write_batch(pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], schema=index))
            held = np.concatenate([held, flat.astype(kind)])
            n_docs, n_tokens = n_docs + len(sizes), n_tokens + len(flat)
            step = BATCH_ROWS * length
            whole = len(held) // step * step
            for i in range(0, whole, step):
                put(held[i : i + step])
            held = held[whole:]
        if sequences is not None:
            if len(held):
                put(held)
            for x in (sequences, documents_file, *streams):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "ids_file": [f"{name}.ids.arrow"], "docs_file": [f"{name}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: DIGEST, with start counted over all parts before its own.

    The manifest has one row per file, so its running sum is small whatever the size of the corpus.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _digests(row["ids_file"], row["docs_file"], row["first"])

    # a number keeps adaptive execution from merging these few rows into one task
    spread = placed.select("ids_file", "docs_file", "first").repartition(max(1, manifest.count()), "ids_file")
    return spread.mapInArrow(read, DIGEST)


def _digests(ids_file: str, docs_file: str, first: int):
    with _open(ids_file, "r") as a, _open(docs_file, "r") as b:
        sequences, index = pa.ipc.open_file(a), pa.ipc.open_file(b)
        flat, batch_no = np.empty(0, "<u4"), 0
        for i in range(index.num_record_batches):
            docs = index.get_batch(i)
            sizes = docs.column(1).to_pylist()
            crcs, starts = [], []
            for n in sizes:
                crc, left = 0, n
                while left:
                    if not len(flat):
                        batch = sequences.get_batch(batch_no)
                        batch_no += 1
                        flat = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
                    part = flat[:left]
                    crc, left, flat = zlib.crc32(part.astype("<u4"), crc), left - len(part), flat[len(part) :]
                crcs.append(crc)
                starts.append(first)
                first += n
            yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts, pa.int64()), docs.column(1), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


class Sequences:
    """Random access to the equal-length sequences of all files of a manifest, in order: ids and mask of sequence k as views of the
    file, which is mapped into memory where it is local. Files are opened when first asked for."""

    def __init__(self, manifest: DataFrame, length: int = SEQUENCE):
        # one row per file
        rows = manifest.orderBy("part").select("ids_file", "n_tokens").collect()
        self.files, self.length, self.open_ = [r.ids_file for r in rows], length, {}
        self.ends = np.cumsum([-(-r.n_tokens // length) for r in rows], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, "right"))
        if at not in self.open_:
            self.open_[at] = pa.ipc.open_file(_open(self.files[at], "r"))
        row = k - (int(self.ends[at - 1]) if at else 0)
        batch = self.open_[at].get_batch(row // BATCH_ROWS)
        begin = row % BATCH_ROWS * self.length
        ids, mask = (batch.column(i).values for i in (0, 1))
        return ids.to_numpy()[begin : begin + self.length], mask.slice(begin, self.length)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), new_folder(spark, "token-files"), default_path())
    return read_token_files(manifest)
