"""Workers of the loops and of the search get rows in bounded batches, and the embedder remembers a bounded number of tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandex.operators import retrieval
from strandex.plans import providers
from strandex.scratch import released


def test_search_bounds_arrow_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key, value in zip(keys, ("10000", "67108864"), strict=True):
        spark.conf.set(key, value)
    v = F.array(*[(F.col("id") + i).cast("double") for i in range(64)])
    chunks = spark.range(3000).select(F.lit(1).alias("video_id"), F.col("id").alias("chunk_id"), v.alias("v_dynamic"))
    asked = chunks.where("chunk_id % 20 = 0").select("video_id", F.col("chunk_id").alias("query_id"), F.col("v_dynamic").alias("q_vec"))
    assert retrieval.nearest(asked, chunks, "video_id", ["query_id"], 3).count() == 450
    assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1])) <= 4 << 20


def test_embedder_remembers_few_tokens(spark, monkeypatch):
    assert providers.HashEmbedder.MOST <= 1 << 16
    texts = spark.range(200).select(F.concat_ws(" ", *[(F.col("id") * 7 + i).cast("string") for i in range(9)]).alias("t"))
    usual = [r[0] for r in texts.select(providers.HashEmbedder()(F.col("t"))).collect()]
    monkeypatch.setattr(providers.HashEmbedder, "MOST", 5)
    assert [r[0] for r in texts.select(providers.HashEmbedder()(F.col("t"))).collect()] == usual


def test_released_gives_memory_back_at_the_end(monkeypatch):
    given = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: given.append(1) or pool)
    assert list(released(lambda batches: (b + 1 for b in batches))([np.int64(1), np.int64(2)])) == [2, 3] and given
