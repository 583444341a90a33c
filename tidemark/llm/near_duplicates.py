"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import documents, free_worker, slices, written
from .shingles import mixed, shingle_hashes, shingle_set, words_of

ROWS, BANDS = 7, 48  # a pair at similarity 0.8 shares no band with probability 1.2e-5, one at 0.1 shares one with 5e-6
HOT = 1024  # share of the rows beyond which a class of equal sets is joined by a broadcast
BLOCK = 512  # members of a cluster that are compared at once with as many others
SLACK = 0.11  # five standard deviations of a signature's agreement at similarity 0.8
SEED = 20_240_501
SLICE_BYTES = 4 << 20  # text sketched at once

MEMBER_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b (mod 2**32) over a set."""
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 256):
        part = (x[i : i + 256, None] * a + b).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def sketches(docs: DataFrame, *, words: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per document: size of its shingle set, a 128-bit key of that set, a key for each band, and the low byte of each minimum."""

    def run(batches):
        free_worker()
        rng = np.random.default_rng(SEED)
        a = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)
        salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            sets = shingle_hashes(batch.column(1), words)
            keys, band_keys, signatures = [], [], []
            for s in sets:
                if not len(s):
                    keys.append(None)
                    band_keys.append(None)
                    signatures.append(None)
                    continue
                low = minima(s, a, b)
                key = salt.copy()
                for row in low.reshape(bands, rows).T.astype(np.uint64):
                    key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + row)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                band_keys.append(key.view(np.int64))
                signatures.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _alike(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough that their sets may be linked.

    Minima agree as often as the sets are similar, and other bytes by chance in one of 256 cases.
    """

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            same = (one == two).mean(axis=1)
            keep = pa.array((same - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one = sketch.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    two = sketch.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets, taken from their whole texts, are similar enough."""

    def run(batches):
        free_worker()
        held: dict[int, set] = {}
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b not in held:
                    held = {b: shingle_set(words_of(tb), words)}
                one, two = shingle_set(words_of(ta), words), held[b]
                common = len(one & two)
                keep.append(common > 0 and 100 * common >= percent * (len(one) + len(two) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # both sides grow with the corpus: never broadcast
    texts = written(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "pair-texts")
    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _near(left: pa.Table, right: pa.Table, least: float):
    """Per row of left, the rows of right whose signatures agree well enough, that lie in another component, and whose pair is
    not met the other way round too."""
    signs = [np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (left, right)]
    ids, parts, sizes = ([t.column(c).to_numpy() for t in (left, right)] for c in ("doc_id", "c", "n_shingles"))
    main = right.column("main").to_numpy(zero_copy_only=False)
    for k in range(left.num_rows):
        same = (signs[1] == signs[0][k]).mean(axis=1)
        near = ((same - 1 / 256) / (1 - 1 / 256) >= least) & (parts[1] != parts[0][k]) & (main | (ids[1] < ids[0][k]))
        # no pair of sets of these sizes is similar enough otherwise
        near &= np.minimum(sizes[1], sizes[0][k]) >= (least + SLACK) * np.maximum(sizes[1], sizes[0][k]) - 1e-6
        yield k, np.flatnonzero(near)


def _across(open_: DataFrame, found: DataFrame, chosen: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components that meet in a bucket; open_: pairs (c, h) of such components.

    Components that meet, directly or over others, form a cluster. The signatures of its members outside the largest
    component are compared with those of all members of other components, block by block inside the tasks; of each pair of
    blocks only the members that are near one of the other block leave the task. Their texts are then sent to that pair of blocks,
    where the near pairs are confirmed, so that only links leave it.
    """
    clusters = components(open_.select(F.col("c").alias("a"), F.col("h").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    of_nodes = chosen.select("doc_id").join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    inside = written(of_nodes.join(clusters, "c"), "clusters")
    largest = inside.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.sum("n").alias("of_all"), (F.sum("n") - F.max("n")).alias("outside"))
    rows = inside.join(largest, "cluster").join(chosen.select("doc_id", "signature", "n_shingles"), "doc_id")
    own, each = F.xxhash64("doc_id"), lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = written(rows.select("cluster", "doc_id", "c", "signature", "n_shingles", (F.col("c") == F.col("main")).alias("main"), each("outside").alias("rows"), each("of_all").alias("columns")), "cluster-rows")
    one = rows.filter("not main").withColumn("i", F.pmod(own, F.col("rows")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    two = rows.withColumn("j", F.pmod(own, F.col("columns")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    least = percent / 100 - SLACK
    keys, kept = ("cluster", "i", "j"), ("cluster", "i", "j", "doc_id", "c", "signature", "n_shingles", "main")
    member = "cluster long, i int, j int, left boolean, doc_id long, c long, signature binary, n_shingles long, main boolean"

    def near_members(left: pa.Table, right: pa.Table) -> pa.Table:
        met = [np.zeros(t.num_rows, bool) for t in (left, right)]
        if left.num_rows and right.num_rows:
            for k, near in _near(left, right, least):
                met[0][k] |= bool(len(near))
                met[1][near] = True
        parts = [t.filter(pa.array(m)).select(list(kept)).add_column(3, "left", pa.array([side] * int(m.sum()), pa.bool_())) for t, m, side in ((left, met[0], True), (right, met[1], False))]
        return pa.concat_tables([p.cast(pa.schema([*zip(p.column_names, MEMBER_TYPES)])) for p in parts])

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        links, sets = [], {}
        if left.num_rows and right.num_rows:
            body, ids = [t.column("text").to_pylist() for t in (left, right)], [t.column("doc_id").to_pylist() for t in (left, right)]

            def set_of(side: int, k: int) -> set:
                if ids[side][k] not in sets:
                    sets[ids[side][k]] = shingle_set(words_of(body[side][k]), words)
                return sets[ids[side][k]]

            for k, near in _near(left, right, least):
                for m in near.tolist():
                    x, y = set_of(0, k), set_of(1, m)
                    common = len(x & y)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        links.append((ids[0][k], ids[1][m]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    members = written(one.select(*kept).groupBy(*keys).cogroup(two.select(*kept).groupBy(*keys)).applyInArrow(near_members, member), "near-members")
    # both sides grow with the corpus: never broadcast
    texts = docs.select("doc_id", "text").join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    full = written(members.join(texts.hint("merge"), "doc_id"), "near-texts")
    side = lambda is_left: full.filter(F.col("left") == is_left).drop("left")
    return side(True).groupBy(*keys).cogroup(side(False).groupBy(*keys)).applyInArrow(confirm, "a long, b long")


def near_duplicate_groups(docs: DataFrame, *, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id linked to it over any path), kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Documents with equal
    sets form a class; the least doc_id stands for it. In each band bucket every class is compared with the bucket's hub,
    the one that meets most others in its buckets; where this leaves components apart that meet in a bucket, the members
    of the smaller ones are compared with those of the others. So all pairs that share a bucket are decided or in one
    component, and a large group of copies costs one comparison for each.
    Null texts, empty texts and texts of white space have no shingles and are linked with nothing. Rows that repeat a
    doc_id share their group. A null doc_id is kept and in no component. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(sketches(docs, words=words, rows=rows, bands=bands), "sketches")
    with_words = sketch.filter("set_key is not null and doc_id is not null")
    classes = written(with_words.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    chosen = written(with_words.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select("set_key", "doc_id", "bands", "signature", "n_shingles").dropDuplicates(["set_key", "doc_id"]).drop("set_key"), "class-sketches")
    members = chosen.select(F.explode("bands").alias("bucket"), "doc_id")
    shared = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    inside = written(members.join(shared, "bucket"), "members")
    degree = written(inside.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degrees")
    inside = written(inside.join(degree, "doc_id").select("bucket", "doc_id", "degree"), "members")
    hubs = written(inside.groupBy("bucket").agg((-F.max(F.struct("degree", -F.col("doc_id")))["col2"]).alias("hub")), "hubs")
    inside = written(inside.drop("degree").join(hubs, "bucket"), "members")
    first = written(inside.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = written(_confirmed(_alike(first, chosen, percent / 100 - SLACK), docs, words, percent), "links")
    found = components(links)
    part_of = inside.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    part_of = part_of.join(found.select(F.col("node").alias("hub"), F.col("component").alias("h")), "hub", "left").withColumn("h", F.coalesce("h", "hub"))
    open_ = written(part_of.filter("c <> h").select("c", "h").distinct(), "open")
    if not open_.isEmpty():
        found = components(links.union(written(_across(open_, found, chosen, docs, words, percent), "links")))
    component = F.coalesce("component", "rep").alias("component")
    grouped = written(classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", "copies", component), "groups")
    every = sketch.select("doc_id", "n_shingles", "set_key")
    # classes with more than a share 1 / HOT of the rows are fewer than HOT: these few rows are broadcast, so no task gets a large class
    hot = F.broadcast(grouped.filter(F.col("copies") > max(1, with_words.count() // HOT)).select("set_key", "component"))
    plain = every.join(hot.select("set_key"), "set_key", "left_anti")
    none = plain.filter("set_key is null").withColumn("component", F.lit(None).cast("long"))
    parts = every.join(hot, "set_key").unionByName(plain.filter("set_key is not null").join(grouped.select("set_key", "component"), "set_key", "left")).unionByName(none)
    return parts.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id. All columns stay, whatever their names."""
    gone = near_duplicate_groups(docs, **how).filter(~F.col("kept")).select("doc_id")
    # the row goes along as one column, so that no name can clash or be taken for a path
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    return packed.join(gone, "doc_id", "left_anti").select("_row.*")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir), words=2, percent=80)
