"""Tables and files that driver and executors share between the steps of an operator."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_KEPT: list[dict] = []


def kept_by_worker(cache: dict) -> dict:
    """A dictionary that stays in a Python worker from task to task, until a task of another kind frees it."""
    _KEPT.append(cache)
    return cache


def free_worker() -> None:
    """Empties what this worker keeps. Stages that use none of it call this first: workers live as long as their executor."""
    if any(_KEPT):
        for cache in _KEPT:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a new local folder becomes it in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that was `written`, once all that read it is written too."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path(folder).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path(folder), True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def tasks_for_bytes(df: DataFrame, column: str, each: int) -> int:
    """How many tasks of about `each` bytes the text of df makes; one pass over that column."""
    total = df.agg(F.sum(F.octet_length(column).cast("long")).alias("b")).first().b or 0
    return max(1, -(-total // each))


def cuts_below(cuts: list[int], column: str) -> Column:
    """How many of the cuts, which are sorted, are less than a column: by halving, so that a row is compared with few of them."""
    if not cuts:
        return F.lit(0)
    cut = F.array(*map(F.lit, cuts))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        open_, above = s["low"] < s["high"], F.get(cut, mid) < F.col(column)
        return F.struct(F.when(open_ & above, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~above, mid).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, step)["low"]


def slices(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices whose texts have `most` bytes, or that are one row: what a task holds does not follow Arrow's batch size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0), "right")))
        # copied, as kernels on parts of an array may read its buffers from their start
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(begin, end - begin), c.slice(0, 0)]) for c in batch.columns], schema=batch.schema)
        begin = end
