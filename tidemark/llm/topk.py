"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, and so are queries. Each pair of blocks is one group: it sorts a list for
each dimension, walks all lists of a query at once from their best end and scores what it meets, until the sum of the
values it stands at cannot beat the k-th score, or all vectors of the block have been met. The k best of each block meet in
a window per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
EVERY = 50  # queries are the rows whose id this divides
BLOCK = 4096  # vectors, or queries, of a block on average
FIRST_DEPTH = 8

FOUND = "query_id long, vec_id long, score long"


class Lists:
    """The vectors of a block and, for each dimension, their places by falling value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.falling = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.falling.T, axis=0).T.copy()
        self.largest = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.shape[1] * self.largest * self.largest < 1 << 52
        self.floats = self.vectors.astype(np.float64) if self.exact else self.vectors

    def _scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        largest = int(np.abs(query).max(initial=0)) * self.largest * len(query)
        if self.exact and largest < 1 << 52:
            return (self.floats[places] @ query.astype(np.float64)).astype(np.int64)
        if largest >= 1 << 63:
            raise OverflowError("inner products of components times 256 do not fit into 64 bits")
        return self.vectors[places] @ query

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places and scores of the k best for a query, ties to the smaller id, its own id left out; and whether the bound ended
        the walk. Otherwise it ends when the lists have shown every vector."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        if not len(up) and not len(down):
            up = np.arange(min(1, self.vectors.shape[1]))  # all products are 0: any list shows all vectors
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, start = min(FIRST_DEPTH, n), 0
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.falling[up, start:depth]] = True
            fresh[self.falling[down, n - depth : n - start]] = True
            fresh &= ~seen
            seen |= fresh
            own = np.flatnonzero(fresh)
            own = own[self.ids[own] != query_id]
            places, scores = np.concatenate([places, own]), np.concatenate([scores, self._scores(own, query)])
            order = np.lexsort((self.ids[places], -scores))[:k]
            places, scores = places[order], scores[order]
            if seen.all():
                return places, scores, False
            bound = sum(int(v) * int(q) for v, q in zip(self.values[up, depth - 1], query[up])) + sum(int(v) * int(q) for v, q in zip(self.values[down, n - depth], query[down]))
            if len(scores) == k and scores[-1] > bound:
                return places, scores, True
            start, depth = depth, min(n, 2 * depth)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, e): floor(256 * x) of each component. Null ids, null and empty vectors and those that hold null or
    non-finite components are left out."""
    x = F.col("embedding")
    # nothing but finite numbers keeps x - x at 0
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & (c.cast("double") - c.cast("double") == 0)), F.lit(False)) & (F.size(x) > 0)
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("e")
    )


def _best_of_blocks(key, vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    as_matrix = lambda t: t.column("e").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    out: list[tuple] = []
    if vectors.num_rows and queries.num_rows:
        lists = Lists(vectors.column("vec_id").to_numpy(), as_matrix(vectors))
        for query_id, query in zip(queries.column("vec_id").to_pylist(), as_matrix(queries)):
            places, scores, _ = lists.best(query_id, query, k)
            out.append((np.full(len(places), query_id), lists.ids[places], scores))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))), schema=pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")]))


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id `every` divides, the k other rows of highest
    integer inner product of floor(256 * x), all if fewer, ties to the smaller vec_id.

    Vectors meet only vectors of their own length. Repeated rows of one vec_id count once (the least vector).
    Components so large that a product may pass 64 bits fail the job: no score is wrong. An empty table gives no rows.
    """
    rows = scaled(vectors).groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("dims", F.size("e"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    n = rows.count()
    blocks, query_blocks = -(-n // block) or 1, -(-n // (every * block)) or 1
    one = rows.withColumn("v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    two = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(key, a, b):
        return _best_of_blocks(key, a, b, k)

    found = one.groupBy("dims", "v", "q").cogroup(two.groupBy("dims", "v", "q")).applyInArrow(best, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
