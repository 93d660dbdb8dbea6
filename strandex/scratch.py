"""Rounds of a loop are written to the folder that all executors share, which cuts their lineage and survives lost executors."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read back. Where that is unset, /tmp serves if all runs on this machine, as in tests."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/strandex"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, so that a worker holds few of the rows with long texts or blocks of vectors at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def released(run):
    """run, a generator over batches, that gives its memory back to the system when its task ends: workers that wait hold little."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidied
