"""Fill-in-middle transformation: documents are cut in three and put together with marks, so that the middle comes last.

Cuts are numbers of code points, and must be found in bytes. Texts are read in chunks of at most CHUNK bytes. A chunk gives
the function of its automaton (see automaton.py): for each state it may be entered in, the state after it and the code
points that it finishes. A text of one chunk is done where it is read. The chunks of longer texts are dealt out over all
tasks; their functions, a few bytes each, meet by text, are composed, and say in which chunk, state and rank each cut lies;
only that chunk of the text is searched again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Tree, automaton, prefixes
from .shared import documents, slices

# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # of 100: share of documents that are cut
SPM_BELOW = 20  # of 100: share of those whose suffix comes first
CHUNK = 1 << 16  # bytes
SLICE_BYTES = 2 << 20  # text whose strips are stepped through at once

FOUND = "struct<n:long, marked:boolean, first_chars:long, second_chars:long, first:long, second:long>"
FUNCTIONS = "key string, one long, other long, no int, ends binary, counts binary"
PLACES = "key string, n long, marked boolean, first_chars long, second_chars long, no array<int>, state array<int>, rank array<long>"


def _tree(chunks: pa.Array, marks: tuple[str, ...]) -> Tree:
    chunks = pc.fill_null(chunks.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return Tree(automaton(marks), data, np.diff(offsets))


def _numbers(id_: Column) -> list[Column]:
    """The first four 8-digit groups of the sha256 of `1:` and an id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _short_cuts(marks: tuple[str, ...]):
    """Code points, marks and cuts of texts of one chunk, with the bytes before each cut."""

    @F.arrow_udf(FOUND)
    def cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts, one, other], names=["text", "one", "other"])
        parts = [[np.empty(0, np.int64)] * 6]
        for part in slices(rows, 0, SLICE_BYTES):
            tree = _tree(part.column(0), marks)
            ends, counts = tree.whole
            n = counts[:, 0]
            pair = np.stack([part.column(1).to_numpy() % (n + 1), part.column(2).to_numpy() % (n + 1)])
            chars = np.sort(pair, axis=0)
            piece = np.arange(len(n))
            bytes_ = [tree.offsets(piece, np.zeros(len(n), np.int64), c) for c in chars]
            parts.append([n, tree.automaton.seen[ends[:, 0]], *chars, *bytes_])
        n, marked, *places = (np.concatenate(c) for c in zip(*parts))
        columns = [pa.array(n), pa.array(marked.astype(bool)), *map(pa.array, places)]
        return pa.StructArray.from_arrays(columns, names=["n", "marked", "first_chars", "second_chars", "first", "second"])

    return cuts


def chunk_functions(chunks: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """FUNCTIONS: one row for each chunk of each key. chunks: key, one, other, no, bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4, SLICE_BYTES):
                ends, counts = _tree(part.column(4), marks).whole
                packed = [[row.tobytes() for row in a] for a in (ends.astype("<i4"), counts.astype("<i8"))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], *(pa.array(p, pa.binary()) for p in packed)],
                    names=["key", "one", "other", "no", "ends", "counts"],
                )

    return chunks.mapInArrow(run, FUNCTIONS)


def _places(key, table: pa.Table, marks: tuple[str, ...]) -> pa.Table:
    """Where the cuts of one text lie: chunk, the state it is entered in, and the unit of it that ends there."""
    table = table.sort_by("no")
    unpack = lambda c, kind: np.stack([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]).astype(np.int64)
    ends, counts = prefixes(unpack("ends", "<i4"), unpack("counts", "<i8"))
    upto, n = counts[:, 0], int(counts[-1, 0])
    chars = sorted(int(table.column(h)[0].as_py()) % (n + 1) for h in ("one", "other"))
    at = [int(np.searchsorted(upto, c)) if c else 0 for c in chars]
    states = [int(ends[i - 1, 0]) if i else 0 for i in at]
    ranks = [c - (int(upto[i - 1]) if i else 0) for i, c in zip(at, chars)]
    marked = bool(automaton(marks).seen[ends[-1, 0]])
    row = [key[0], n, marked, *chars, at, states, ranks]
    names = [c.split()[0] for c in PLACES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], schema=pa.schema(list(zip(names, kinds))))


def _long_cuts(docs: DataFrame, marks: tuple[str, ...], chunk: int) -> DataFrame:
    """docs with `found`, for texts of several chunks. docs: text, one, other and any more columns."""
    binary = F.col("text").cast("binary")
    # rows of one key have one text and one pair of numbers, so it does not matter how often a key occurs
    numbers = F.concat_ws(",", F.col("one"), F.col("other"), F.lit(""))
    keyed = docs.withColumn("key", F.sha2(F.concat(numbers.cast("binary"), binary), 256))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int")),
        lambda i: F.substring(binary, i * chunk + 1, F.lit(chunk)),
    )
    chunks = keyed.select("key", "one", "other", F.posexplode(pieces).alias("no", "bytes")).hint("rebalance")
    functions = chunk_functions(chunks, marks).dropDuplicates(["key", "no"])

    def places(key, table):
        return _places([k.as_py() for k in key], table, marks)

    # one row for each 64 KiB of a text, whose length a string's limits bound
    found = functions.groupBy("key").applyInArrow(places, PLACES)

    @F.arrow_udf("long")
    def inside(bytes_: pa.Array, state: pa.Array, rank: pa.Array) -> pa.Array:
        rows, out = pa.RecordBatch.from_arrays([bytes_, state, rank], names=["bytes", "state", "rank"]), [np.empty(0, np.int64)]
        for part in slices(rows, 0, SLICE_BYTES):
            tree, piece = _tree(part.column(0), marks), np.arange(part.num_rows)
            out.append(tree.offsets(piece, part.column(1).to_numpy().astype(np.int64), part.column(2).to_numpy()))
        return pa.array(np.concatenate(out))

    def cut(k: int) -> Column:
        at = F.col("no")[k]
        return at.cast("long") * chunk + inside(F.substring(binary, at * chunk + 1, F.lit(chunk)), F.col("state")[k], F.col("rank")[k])

    joined = keyed.join(found, "key")
    columns = ["n", "marked", "first_chars", "second_chars", cut(0).alias("first"), cut(1).alias("second")]
    return joined.select(*docs.columns, F.struct(*columns).alias("found"))


def fill_in_middle(
    docs: DataFrame, *, marks: tuple[str, ...] = MARKS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, chunk: int = CHUNK
) -> DataFrame:
    """Per row of docs: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    form: plain, psm or spm. Prefix ends after the smaller, middle after the larger of two numbers of code points, which
    follow from doc_id and n alone. Plain rows keep their text, and have no cuts (null): empty texts, those that hold a
    mark, and a share by doc_id. `chunk` changes no result.

    Null texts count as empty, null doc_ids as no digits. Repeated rows give repeated rows; ties do not arise. Texts are
    read as a whole, however long. Other columns of docs are not read, whatever their names. No rows give none.
    """
    one, other, third, fourth = _numbers(F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        one.alias("one"), other.alias("other"), third.alias("third"), fourth.alias("fourth"),
    )
    fits = F.octet_length("text") <= chunk
    short = rows.filter(fits).withColumn("found", _short_cuts(marks)("text", "one", "other"))
    long_ = _long_cuts(rows.filter(~fits), marks, chunk)
    return short.unionByName(long_).select("doc_id", "text", "third", "fourth", "found.*").select(
        "doc_id", "n", *_formed(marks, plain_from, spm_below)
    )


def _formed(marks: tuple[str, ...], plain_from: int, spm_below: int) -> list[Column]:
    """form, prefix_chars, middle_chars and output of rows with their cuts."""
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("third") % 100 >= plain_from)
    spm = F.col("fourth") % 100 < spm_below
    text, first, second = F.col("text").cast("binary"), F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in marks)
    output = F.when(plain, text).when(spm, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    return [
        F.when(plain, "plain").when(spm, "spm").otherwise("psm").alias("form"),
        F.when(~plain, F.col("first_chars")).alias("prefix_chars"),
        F.when(~plain, F.col("second_chars") - F.col("first_chars")).alias("middle_chars"),
        output.cast("string").alias("output"),
    ]


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output was made of."""

    def part(mark: str) -> Column:
        after = F.split_part(output, F.lit(mark), F.lit(2))
        for end in marks:
            after = F.split_part(after, F.lit(end), F.lit(1))
        return after

    return F.when(form == "plain", output).otherwise(F.concat(part(marks[0]), part(marks[2]), part(marks[1])))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; see fill_in_middle for what null, empty, long and repeated rows give."""
    rows = fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
           OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
  SELECT *, substring(t, 1, least(a, b)) AS pre, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid,
    substring(t, greatest(a, b) + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
