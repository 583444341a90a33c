"""Mixing sources to target weights by Pfair scheduling. DataFrame functions; one period is scheduled on the driver.

A source's documents, in the order of doc_id, are cut into blocks of about BLOCK_BYTES. Target weights are rounded to shares
of a period: PERIOD slots, or SLOTS_EACH for every source where that is more. Block j (from 0) of a source with share a may start at slot floor(j * period / a) and must be done by
slot ceil((j + 1) * period / a). Each slot goes to the block of earliest deadline among those released, one per source; so
after any number of slots each source is less than one block away from its weight. The schedule repeats after a
period, so one period of it is made, whatever the size of the corpus.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cuts_below, documents, written

PERIOD = 1000  # slots, at least
SLOTS_EACH = 50  # slots of a period for each source, at least: a weight is met to a fiftieth of itself and two slots
BROADCAST_SLOTS = 1 << 20  # a longer period is joined by a shuffle
BLOCK_BYTES = 64 << 10
PART_ROWS = 1_000_000  # rows of a part of the ids; running sums are taken side by side in the parts of a source
LEAST_PARTS, MOST_PARTS = 64, 1 << 14
SMOOTHING = 0.5  # default target: share of bytes to this power


def shares(totals: DataFrame, weights: dict[str, float] | None, period: int, smoothing: float) -> DataFrame:
    """(source, share): whole slots of a period for each source, at least one, largest remainders first; ties by source.

    totals: source, bytes. weights: target weights by source, others get none of the period's slots; without them a
    source's target is its bytes to the power `smoothing`. There is one row per source: sources are taken to be few.
    """
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        raw = F.coalesce(F.try_element_at(given, "source"), F.lit(0.0))
    else:
        raw = F.pow(F.greatest(F.col("bytes"), F.lit(1)).cast("double"), smoothing)
    every = Window.partitionBy(F.lit(0))
    rows = totals.withColumn("raw", raw).filter("raw > 0").withColumn("n", F.count(F.lit(1)).over(every))
    # one slot for each, the rest by weight
    rows = rows.withColumn("exact", F.col("raw") / F.sum("raw").over(every) * (period - F.col("n"))).withColumn("low", F.floor("exact"))
    left = F.lit(period) - F.col("n") - F.sum("low").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 9)), "source"))
    rows = rows.withColumn("left", left).withColumn("rank", rank)
    return rows.select("source", (1 + F.col("low") + (F.col("rank") <= F.col("left")).cast("long")).cast("int").alias("share"))


def period_of(sources: int, period: int | None = None) -> int:
    """Slots of a period: by the number of sources; one that is given is taken, as often as all sources need for a slot."""
    if period is None:
        return max(PERIOD, SLOTS_EACH * sources)
    return period * max(1, -(-sources // period))


def schedule(shares_: DataFrame, period: int) -> DataFrame:
    """(source, nth, slot) of one period: which slot the nth block (from 0) of each source gets. `period` rows.

    There is one row per source, and the picks are made on the driver: a heap of blocks by release, one by deadline.
    """
    rows = shares_.orderBy("source").collect()
    share = [r["share"] for r in rows]
    nth = np.zeros(period if rows else 0, np.int32)
    which = np.zeros(len(nth), np.int32)
    later, open_, done = [(0, i) for i in range(len(rows))], [], [0] * len(rows)
    for t in range(len(nth)):
        while later and later[0][0] <= t:
            _, i = heapq.heappop(later)
            heapq.heappush(open_, (-(-(done[i] + 1) * period // share[i]), i))
        _, i = heapq.heappop(open_)
        nth[t], which[t] = done[i], i
        done[i] += 1
        if done[i] < share[i]:
            heapq.heappush(later, (done[i] * period // share[i], i))
    names = pa.array([r["source"] for r in rows], pa.string()).take(pa.array(which))
    return shares_.sparkSession.createDataFrame(pa.table({"source": names, "nth": nth, "slot": np.arange(len(nth), dtype=np.int32)}))


def mixed(docs: DataFrame, *, weights: dict[str, float] | None = None, period: int | None = None, block_bytes: int = BLOCK_BYTES, parts: int | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """Per row of docs: doc_id, source, n_bytes, block (of its source, from 0), slot, release, deadline.

    Nothing is dropped or repeated: a source that has no more blocks leaves its slots empty. Documents of a source without
    a target follow after all others: slot, release and deadline are null. A block holds the documents that begin in its
    BLOCK_BYTES of the source's bytes, so a longer document takes several blocks' worth and leaves those after it out.
    Null texts have 0 bytes; a null source is one of its own; null ids come first, ties keep any order.
    An empty table gives no rows. A source may hold any share of the rows: its running sum is taken in `parts`
    ranges of ids, as many as the rows ask for (64 to 16,384).
    """
    source = F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    if parts is None:
        parts = min(MOST_PARTS, max(LEAST_PARTS, docs.count() // PART_ROWS))
    cuts = rows.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts).alias("c")).first().c or []
    cuts = sorted({c for c in cuts if c is not None})
    rows = rows.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), cuts_below(cuts, "doc_id")), F.lit(-1)).cast("int"))
    totals = written(rows.groupBy("source", "part").agg(F.sum("n_bytes").alias("bytes")), "source-bytes")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("source", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("source", "part").orderBy(F.asc_nulls_first("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(begins, ["source", "part"])
    rows = rows.withColumn("block", F.floor((F.col("own") + F.col("begin")) / block_bytes))
    named = None if weights is None else {f"+{k}": v for k, v in weights.items()}
    sums = totals.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    period = period_of((sums.filter(F.col("source").isin([k for k, v in named.items() if v > 0])) if named else sums).count(), period)
    each = written(shares(sums, named, period, smoothing), "source-shares")
    plan = written(schedule(each, period).withColumnRenamed("slot", "at"), "schedule")
    rows = rows.join(F.broadcast(each), "source", "left").withColumn("nth", (F.col("block") % F.col("share")).cast("int"))
    # `period` rows
    placed = rows.join(F.broadcast(plan) if period <= BROADCAST_SLOTS else plan, ["source", "nth"], "left")
    share, block = F.col("share"), F.col("block")
    return placed.select(
        "doc_id",
        F.when(F.col("source").startswith("+"), F.substring("source", 2, 1 << 30)).alias("source"),
        "n_bytes",
        "block",
        (F.floor(block / share) * period + F.col("at")).alias("slot"),
        F.floor(block * period / share).alias("release"),
        F.ceil((block + 1) * period / share).alias("deadline"),
    )


def first_slots(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, slot): the first slot of each id; repeated rows of an id share it."""
    return mixed(docs, **how).groupBy("doc_id").agg(F.min("slot").alias("slot"))


def in_mixed_order(docs: DataFrame, *, tasks: int | None = None, **how) -> DataFrame:
    """docs with all rows and columns, in the order of their slots: ranges of slots go to partitions, sorted within.

    Documents of one slot keep the order of their ids; repeated rows of an id share its first slot. Files that are read
    again need not keep the order: who goes by it then takes first_slots of the rows read.
    """
    slots = first_slots(docs, **how).select(F.col("doc_id").alias("_id"), F.col("slot").alias("_slot"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"))
    both = packed.join(slots.hint("merge"), F.col("_own").eqNullSafe(F.col("_id")), "left")
    order = [F.asc_nulls_last("_slot"), F.asc_nulls_first("_own")]
    dealt = both.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
    return dealt.select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, strlen(coalesce(text, '')) AS b FROM documents
), r AS (
  SELECT s, sqrt(greatest(sum(b), 1)) AS raw, count(*) OVER () AS n FROM d GROUP BY s
), x AS (
  SELECT s, n, raw / sum(raw) OVER () * (1000 - n) AS exact FROM r
), z AS (
  SELECT s, CAST(1 + floor(exact) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, s) <= 1000 - n - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS a FROM x
), one AS (
  SELECT list(a ORDER BY s) AS a, list(s ORDER BY s) AS names FROM z
), step AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda v: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM one
  UNION ALL
  SELECT t, list_transform(done, lambda v, i: v + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t + 1 AS t, done, CAST(list_min(list_filter(list_transform(done, lambda v, i:
      CASE WHEN v < a[i] AND v * 1000 // a[i] <= t + 1 THEN {'deadline': CAST(ceil((v + 1) * 1000 / a[i]) AS BIGINT), 'i': i} END), lambda q: q IS NOT NULL)).i AS BIGINT) AS pick
    FROM step, one WHERE t < 999)
), slots AS (
  SELECT names[pick] AS s, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM step, one WHERE t >= 0
), blocks AS (
  SELECT d.*, a, coalesce(sum(b) OVER (PARTITION BY d.s ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 65536 AS block FROM d JOIN z ON d.s = z.s
)
SELECT doc_id, source, b AS n_bytes, block, block // a * 1000 + slot AS slot, block * 1000 // a AS release, CAST(ceil((block + 1) * 1000 / a) AS BIGINT) AS deadline
FROM blocks JOIN slots ON blocks.s = slots.s AND slots.nth = block % a
"""
