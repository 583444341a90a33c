"""Whitening of embeddings by their principal components.

Components become whole numbers. Two passes over the distinct vectors (the fit list) give the covariance: exact integer
sums make the mean, then centred outer products are summed by matrix products, task by task, and merged by a tree. The
driver holds one matrix of dimensions squared, whose eigenvectors go to all tasks as a projection.
"""

from __future__ import annotations

import pickle
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BATCH_NUMBERS = 1 << 20  # components that are centred at once
FLAT = 1e-12  # an eigenvalue of less than this share of the largest has no direction that can be scaled
MOST_LONG = (1 << 63) - 1
DIGITS = 10**38  # of the decimals that deviations are given in

PARTIAL = "dims int, n long, data binary"
PARTIAL_SCHEMA = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
WHITENED = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 * c) + 1000000 of each component c. Null and empty vectors and those that hold null or
    non-finite components are left out; a component whose x isn't within a quarter of 64 bits is refused."""
    c = F.col(column)
    # nothing but finite numbers keeps v - v at 0
    whole = F.coalesce(F.forall(c, lambda v: v.isNotNull() & (v.cast("double") - v.cast("double") == 0)), F.lit(False)) & (F.size(c) > 0)

    def number(v):
        low = F.floor(v.cast("double") * SCALE)
        return F.when(F.abs(v.cast("double")) < float(1 << 55), low + SHIFT).otherwise(
            F.raise_error(F.lit("components of 2^55 and more do not fit into whole numbers")).cast("long")
        )

    return vectors.filter(c.isNotNull()).filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, number).alias("x"))


def _matrices(batch: pa.RecordBatch, column: int):
    """Rows of the batch by the length of their vectors, a bounded number at a time: row numbers and a matrix."""
    lists = batch.column(column)
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        step = max(1, BATCH_NUMBERS // int(dims))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, flat[offsets[part][:, None] + np.arange(dims)]


def _summed(fit_list: DataFrame, zero, of_matrix, merge) -> dict[int, tuple[int, object]]:
    """For each length of vectors: their number and the sum of what of_matrix(dims, x) gives. Each task sums what it reads;
    the sums of tasks, a row for each length, are merged by a tree. merge(a, b) may change a."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for rows, x in _matrices(batch, 0):
                dims = x.shape[1]
                own = held.setdefault(dims, [0, zero(dims)])
                own[0] += len(rows)
                own[1] = merge(own[1], of_matrix(dims, x))
        for dims, (n, data) in held.items():
            yield pa.RecordBatch.from_pydict({"dims": [dims], "n": [n], "data": [pickle.dumps(data)]}, PARTIAL_SCHEMA)

    def add(all_, row):
        n, data = all_.get(row.dims, (0, None))
        own = pickle.loads(row.data)
        all_[row.dims] = (n + row.n, own if data is None else merge(data, own))
        return all_

    def both(a, b):
        for dims, (n, data) in b.items():
            m, own = a.get(dims, (0, None))
            a[dims] = (n + m, data if own is None else merge(own, data))
        return a

    # one short row of each task; what remains is the tree
    return fit_list.mapInArrow(run, PARTIAL).rdd.treeAggregate({}, add, both, depth=3)


def _plus(a, b):
    return a + b


def exact_sums(fit_list: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and exact sum of each dimension, as Python integers, by length of vectors."""

    def sums(dims: int, x: np.ndarray) -> np.ndarray:
        # halves of 32 bits cannot overflow within a batch
        return (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)

    return _summed(fit_list, lambda dims: np.zeros(dims, object), sums, _plus)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    if (int(np.abs(x).max(initial=0)) + 1) * n < MOST_LONG // 2:
        return x * np.int64(n) - total.astype(np.int64)
    return x.astype(object) * n - total


def _products(fit_list: DataFrame, means: dict, project: dict | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Sums of outer products of centred vectors, projected if told so, by length of vectors."""

    def products(dims: int, x: np.ndarray) -> np.ndarray:
        n, total = means[dims]
        centred = (_centred(x, n, total) / n).astype(np.float64)
        if project is not None:
            centred = centred @ project[dims][0]
        return centred.T @ centred

    width = (lambda dims: project[dims][0].shape[1]) if project is not None else (lambda dims: dims)
    return _summed(fit_list, lambda dims: np.zeros((width(dims), width(dims))), products, _plus)


def projection(n: int, products: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors over the root of their eigenvalues, as columns by falling eigenvalue, and the shares of the trace.

    Signs are such that the largest entry is positive. Directions without variance are left out.
    """
    values, directions = np.linalg.eigh(products / n)
    values, directions = values[::-1], directions[:, ::-1]
    kept = int((values > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    values, trace, directions = values[:kept], np.trace(products) / n, directions[:, :kept]
    largest = np.abs(directions).argmax(axis=0)
    return directions * np.sign(directions[largest, np.arange(kept)]) / np.sqrt(values), values / trace if kept else values


def whiten(vectors: DataFrame, *, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """WHITENED: for each row of vectors and each component from 1, by falling eigenvalue of the covariance of the distinct
    vectors: the projection of the centred vector over the root of the eigenvalue.

    n and the covariance are those of the distinct vectors; deviation is the exact sum over dimensions of (n*x - S)^2, null
    if it has more than 38 digits.
    identity_error says how far the whitened distinct vectors' covariance is from the identity, at most.

    Rows with a null or empty vector, or null or non-finite components, are left out; null and repeated vec_ids are kept.
    Repeated vectors count once in the fit. Vectors of different lengths are fitted apart, each by those of its own length;
    lengths are taken to be few, as the driver holds a matrix for each. Directions without variance have no component, so a
    single distinct vector gives no rows, as an empty table does. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, column)
    fit_list = written(rows.select("x").distinct(), "whitening-fit")
    means = exact_sums(fit_list)
    project = {dims: projection(n, m, components) for dims, (n, m) in _products(fit_list, means).items()}
    again = _products(fit_list, means, project)
    error = max((float(np.abs(m / n - np.eye(len(m))).max(initial=0.0)) for n, m in again.values()), default=0.0)
    shared = spark.sparkContext.broadcast((means, project))

    def run(batches):
        means, project = shared.value
        for batch in batches:
            for part, x in _matrices(batch, 1):
                (n, total), (directions, explained) = means[x.shape[1]], project[x.shape[1]]
                k = len(explained)
                whole = _centred(x, n, total)
                whitened = (whole / n).astype(np.float64) @ directions
                largest = int(np.abs(whole).max(initial=0))
                if x.shape[1] * largest * largest > MOST_LONG:
                    whole = whole.astype(object)
                squares = (whole * whole).sum(axis=1)
                if squares.dtype == object:
                    deviation = pa.array([Decimal(q) if q < DIGITS else None for q in squares.tolist()], pa.decimal128(38, 0))
                else:
                    deviation = pa.array(squares).cast(pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part)).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(part) * k, n)), deviation.take(again),
                        pa.array(whitened.ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(part) * k, error)),
                    ],
                    names=[c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(run, WHITENED)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; a deviation that does not fit into 64 bits is null. See whiten for what odd rows give."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
