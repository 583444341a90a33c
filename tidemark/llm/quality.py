"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

A text is summed up by STATISTICS, numbers about its characters, words, repeats and lines. Standardized, they are mapped to
cosines of random projections, whose inner products approximate a Gaussian kernel. Tasks sum the normal equations of a
linear fit over the labelled documents that they read; the sums are merged by a tree and solved on the driver, where they
have FEATURES squared numbers whatever the corpus. Half of the documents (by hash) give the raw scores of the other half,
whose labels then calibrate scores by isotonic regression over bins.
"""

from __future__ import annotations

import io
import pickle
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, slices, written

FEATURES = 384  # cosines
WIDTH = 1.0  # of the kernel, times the root of the number of statistics
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2)  # times the number of documents; the best on the other half is taken
CLIP = 4.0  # standard deviations
BINS = 2048  # of raw scores from LOW to HIGH
LOW, HIGH = -0.5, 1.5
UNTIED = 0.01  # share of the raw score in a score: tells apart what calibration ties
SEED = 13
SLICE_BYTES = 2 << 20  # text summed up at once

STATISTICS = (
    "log_words", "word_bytes", "word_bytes_deviation", "longest_word",
    "upper", "digits", "stops", "symbols", "high_bytes", "spaces", "entropy",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines",
    "symbol_ends", "capital_words", "upper_words",
    "letterless_words", "sentence_ends", "lines", "short_words", "stuttered",
)
KINDS = np.zeros(256, np.uint8)  # other bytes are symbols: 0
for _kind, _members in enumerate((string.ascii_uppercase, string.ascii_lowercase, string.digits, ".,;:!?'\"-()", " \t\n\r\x0b\x0c"), 1):
    KINDS[[ord(c) for c in _members]] = _kind
KINDS[128:] = 6
UPPER, LOWER, DIGIT, STOP, SPACE, HIGH_BYTE = range(1, 7)


def _distinct(doc: np.ndarray, item: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many different items it has, and how often the commonest occurs."""
    if not len(doc):
        return np.zeros(docs), np.zeros(docs)
    pairs, times = np.unique(doc * (int(item.max()) + 1) + item, return_counts=True)
    owner = pairs // (int(item.max()) + 1)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=docs).astype(float), most.astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """STATISTICS of each text, as rows. Null: as an empty text, all 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    kind = KINDS[data]
    kinds = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    bytes_ = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256) / np.maximum(sizes, 1)[:, None]
    entropy = -(bytes_ * np.log2(np.where(bytes_ > 0, bytes_, 1))).sum(1)
    letters = np.maximum(kinds[:, UPPER] + kinds[:, LOWER] + kinds[:, HIGH_BYTE], 1)
    size = np.maximum(sizes, 1)

    # words are runs of bytes that aren't white space; none crosses a text
    space = kind == SPACE
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] | space[:-1] | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(edge[:-1] & ~space) if len(data) else np.empty(0, np.int64)
    end = np.flatnonzero(edge[1:] & ~space) + 1 if len(data) else np.empty(0, np.int64)
    owner, length = doc[begin], (end - begin).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    per = np.maximum(words, 1)
    summed = lambda x: np.bincount(owner, x, n)
    mean = summed(length) / per
    deviation = np.sqrt(np.maximum(summed(length**2) / per - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)

    def inside(*which: int) -> np.ndarray:
        """Bytes of these kinds in each word."""
        upto = np.concatenate(([0], np.cumsum(np.isin(kind, which), dtype=np.int64)))
        return upto[end] - upto[begin]

    upper, all_letters = inside(UPPER), inside(UPPER, LOWER, HIGH_BYTE)
    split = pc.split_pattern_regex(texts, r"[ \t\n\r\v\f]+")
    word = pc.dictionary_encode(split.flatten()).indices.to_numpy()
    word_doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    distinct, most = _distinct(word_doc, word, n)
    same = word_doc[1:] == word_doc[:-1]
    couples = word[:-1].astype(np.int64) * (int(word.max(initial=0)) + 1) + word[1:]
    _, couple = np.unique(couples[same], return_inverse=True)
    distinct_pairs, _ = _distinct(word_doc[1:][same], couple, n)
    stuttered = np.bincount(word_doc[1:][same & (word[1:] == word[:-1])], minlength=n)
    tokens = np.maximum(np.diff(split.offsets.to_numpy()), 1)
    rows = pc.split_pattern(texts, "\n")
    lines = np.maximum(np.diff(rows.offsets.to_numpy()), 1)
    line_doc = np.repeat(np.arange(n), np.diff(rows.offsets.to_numpy()))
    distinct_lines, _ = _distinct(line_doc, pc.dictionary_encode(rows.flatten()).indices.to_numpy(), n)
    last = kind[end - 1] if len(end) else np.empty(0, np.uint8)
    full_stop = np.isin(data[end - 1], [ord(c) for c in ".!?"]) if len(end) else np.empty(0, bool)
    shares = {k: kinds[:, k] / size for k in (0, DIGIT, STOP, SPACE, HIGH_BYTE)}
    out = np.column_stack([
        np.log1p(words), mean, deviation, np.log1p(longest),
        kinds[:, UPPER] / letters, shares[DIGIT], shares[STOP], shares[0], shares[HIGH_BYTE], shares[SPACE], entropy,
        np.log1p(distinct) - np.log1p(tokens), most / tokens, distinct_pairs / np.maximum(tokens - 1, 1), 1 - distinct_lines / lines,
        summed(last == 0) / per, summed(kind[begin] == UPPER) / per, summed((upper == all_letters) & (all_letters > 1)) / per,
        summed(all_letters == 0) / per, summed(full_stop) / per, np.log1p(lines), summed(length <= 2) / per, stuttered / tokens,
    ])
    out[sizes == 0] = 0
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs with an array column `statistics` instead of text."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        parts = [np.empty((0, len(STATISTICS)))]
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE_BYTES):
            parts.append(statistics(part.column(0)))
        rows = np.concatenate(parts)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return docs.withColumn("statistics", of(F.col("text").cast("string"))).drop("text")


def _tree_sum(rows: DataFrame, of_batch):
    """The sum of of_batch(statistics, label, half), a list of arrays, over all batches; None without rows."""

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = of_batch(x, batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy())
                held = own if held is None else [a + b for a, b in zip(held, own)]
        if held is not None:
            yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(held)]})

    def add(held, row):
        own = pickle.loads(row.sums)
        return own if held is None else [a + b for a, b in zip(held, own)]

    def both(a, b):
        return a if b is None else b if a is None else [x + y for x, y in zip(a, b)]

    # one row of each task; what remains is the tree
    return rows.mapInArrow(run, "sums binary").rdd.treeAggregate(None, add, both, depth=3)


class Features:
    """Cosines of random projections of standardized statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        rng = np.random.default_rng(SEED)
        self.ways = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.ways + self.phases), np.ones(len(z))])


def ridge(products: np.ndarray, targets: np.ndarray, strength: float) -> np.ndarray:
    """Weights of least squares with a penalty of strength times the number of rows; the constant, last, has none."""
    penalty = np.full(len(products), strength * products[-1, -1])
    penalty[-1] = 1e-9
    return np.linalg.solve(products + np.diag(penalty), targets)


def _error(w: np.ndarray, products: np.ndarray, targets: np.ndarray, squares: float) -> float:
    return float(squares - 2 * w @ targets + w @ products @ w)


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rising means of bins nearest to their own by least squares: neighbours that fall are pooled. Bins without rows
    are filled up between those beside them."""
    pools: list[list[float]] = []  # sum, weight, first bin, last bin
    for k in np.flatnonzero(rows):
        pools.append([ones[k], rows[k], k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
    ends = [e for _, _, first, last in pools for e in (first, last)]
    means = [s / w for s, w, _, _ in pools for _ in (0, 1)]
    return np.interp(np.arange(len(rows)), ends, means)


def fit(rows: DataFrame) -> bytes | None:
    """A model fitted to rows (statistics, label, half); None without rows of both labels and halves.

    Sums of one pass give means and deviations, those of a second the normal equations of each half, those of a third the
    labels by bin of the raw scores from the other half. The model is under a megabyte.
    """
    moments = _tree_sum(rows, lambda x, y, _: [np.array([float(len(x)), y.sum()]), x.sum(0), (x**2).sum(0)])
    if moments is None or moments[0][1] in (0, moments[0][0]):
        return None
    mean = moments[1] / moments[0][0]
    features = Features(mean, np.sqrt(np.maximum(moments[2] / moments[0][0] - mean**2, 0)))

    def equations(x, y, half):
        z, out = features(x), []
        for h in (0, 1):
            own, target = z[half == h], y[half == h]
            out += [own.T @ own, own.T @ target, np.array(target.sum())]
        return out

    p0, t0, s0, p1, t1, s1 = _tree_sum(rows, equations)
    if not (p0[-1, -1] and p1[-1, -1]):
        return None
    pairs = {r: (ridge(p0, t0, r), ridge(p1, t1, r)) for r in RIDGES}
    best = min(RIDGES, key=lambda r: _error(pairs[r][0], p1, t1, s1) + _error(pairs[r][1], p0, t0, s0))
    of_half = np.stack(pairs[best])

    def binned(x, y, half):
        raw = (features(x) * of_half[1 - half]).sum(1)
        place = _bins(raw).round().astype(np.int64)
        return [np.bincount(place, y, BINS), np.bincount(place, minlength=BINS).astype(float)]

    curve = isotonic(*_tree_sum(rows, binned))
    out = io.BytesIO()
    np.savez(out, mean=features.mean, deviation=features.deviation, weights=ridge(p0 + p1, t0 + t1, best), curve=curve)
    return out.getvalue()


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW), 0, 1) * (BINS - 1)


class Scorer:
    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model))
        self.features, self.weights, self.curve = Features(m["mean"], m["deviation"], len(m["weights"]) - 1), m["weights"], m["curve"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        calibrated = np.interp(_bins(raw), np.arange(BINS), self.curve)
        return np.clip((1 - UNTIED) * calibrated + UNTIED * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 0, 1)


def held_out(column: str = "doc_id"):
    """True for the rows that no fit learns from: a third, by crc32 of doc_id as text. Null doc_ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) of each row of docs; learnt from labels (doc_id, quality) of rows not held out.

    All labelled rows are learnt from. Null labels don't count; of repeated ones the largest does; rows that repeat a doc_id
    all count. Null and empty texts have statistics of 0 and a score like any. Without labels of both kinds scores are 0.5.
    Texts are read as a whole. Other columns of docs are not read, whatever their names. No rows give none.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = written(document_statistics(narrow).withColumn("held_out", held_out()), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    train = stats.filter(~F.col("held_out")).join(known, "doc_id").select("statistics", "label", half.alias("half"))
    model = fit(written(train, "quality-training"))
    if model is None:
        return stats.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    held: list[Scorer] = []

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(model))
        return pa.array(held[0](x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.empty(0))

    return stats.select("doc_id", "held_out", score("statistics").alias("score"))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; see quality_scores for what null, empty and repeated rows give."""
    scored = quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
