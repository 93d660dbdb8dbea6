"""Operators over ordered sequences: similarity sessions, tumbling windows and their pyramid, samples and caps.

Each is a window or an aggregation by the sequence's key, so sequences run in parallel; a single sequence is as long as one video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.vector import dot
from strandex.scratch import written


def sessions(frames: DataFrame, by: str, order: list[str], vector: str, theta: float, longest: int) -> DataFrame:
    """Adds raw_group, numbered from 0 in each sequence: a frame starts one where its product with the frame before is below theta, or
    where the group has reached its longest."""
    w = Window.partitionBy(by).orderBy(*order)
    prev = F.lag(vector).over(w)
    island = frames.withColumn("_new", F.when(prev.isNull() | (dot(F.col(vector), prev) < theta), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    part = island.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(by, "_island").orderBy(*order)) - 1) / longest))
    return part.withColumn("raw_group", F.dense_rank().over(Window.partitionBy(by).orderBy("_island", "_part")) - 1).drop("_new", "_island", "_part")


def fold_short(grouped: DataFrame, by: str, least: int) -> DataFrame:
    """Adds chunk_idx: groups of fewer than least frames join their left neighbour; a sequence's first group never does."""
    size = grouped.groupBy(by, "raw_group").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy("raw_group")
    head = size.withColumn("_head", F.when((F.col("_n") >= least) | (F.row_number().over(w) == 1), 1).otherwise(0))
    return grouped.join(head.select(by, "raw_group", (F.sum("_head").over(w) - 1).alias("chunk_idx")), [by, "raw_group"])


def attributes(chunks: DataFrame, by: str, order: list[str], ts: str) -> DataFrame:
    """One row a chunk: size, t_start, t_end (a second after the last frame), the middle frame's row."""
    w = Window.partitionBy(by, "chunk_idx").orderBy(*order)
    whole = Window.partitionBy(by, "chunk_idx")
    ranked = chunks.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    return ranked.groupBy(by, "chunk_idx").agg(F.count(F.lit(1)).alias("size"), F.min(ts).alias("t_start"), (F.max(ts) + 1).alias("t_end"), F.max(F.when(F.col("_rn") == F.floor(F.col("_n") / 2), F.col(order[-1]))).alias("center"))


def keyframe(chunks: DataFrame, by: str, order: list[str], sharpness: str, enough: float) -> DataFrame:
    """One frame a chunk: the middle one if it is sharp enough, else the sharpest (the first of equals; unknown sharpness never)."""
    w = Window.partitionBy(by, "chunk_idx")
    rows = chunks.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    middle = F.max(F.when((F.col("_rn") == F.floor(F.col("_n") / 2)) & (F.col(sharpness) >= enough), F.col(order[-1])))
    best = F.max_by(order[-1], F.when(F.col(sharpness).isNotNull(), F.struct(F.col(sharpness), -F.col("_rn"))))
    return rows.groupBy(by, "chunk_idx").agg(F.coalesce(middle, best).alias("keyframe"))


def sharpest(rows: DataFrame, by: list[str], order: str, sharpness: str, k: int) -> DataFrame:
    """The k sharpest rows of each group; of equals the later wins. Callers restore the order by `order`."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(sharpness), F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def unless_most(rows: DataFrame, by: list[str], bad: Column, most: float = 0.5) -> DataFrame:
    """Drops the bad rows of each group, or none where they are more than a share of it."""
    share = F.avg(F.coalesce(bad, F.lit(True)).cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("_bad", F.coalesce(bad, F.lit(True))).withColumn("_share", share).where(~F.col("_bad") | (F.col("_share") > most)).drop("_bad", "_share")


def tumbling(events: DataFrame, by: list[str], at: Column, span: int, *aggs: Column) -> DataFrame:
    """Windows [idx * span, (idx + 1) * span) that hold an event, with aggregates."""
    return events.withColumn("idx", F.floor(at / span).cast("bigint")).groupBy(*by, "idx").agg(*aggs)


def roll_up(children: DataFrame, by: list[str], span: int) -> DataFrame:
    """The next layer of a pyramid: parents of children (idx, t_start, t_end, text, n) by start time, texts in order, empty parents skipped."""
    parent = F.floor(F.col("t_start") / span).cast("bigint")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_start", "text"))), lambda s: s.text), " ")
    rolled = children.withColumn("_p", parent).groupBy(*by, F.col("_p").alias("idx")).agg(F.max("t_end").alias("t_end"), text.alias("text"), F.sum("n").cast("bigint").alias("n"))
    return rolled.withColumn("t_start", F.col("idx") * span)


def stride_sample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows spread evenly over each ordered group: every max(1, n div k)-th."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / k)))
    return r.where((F.col("_rn") % F.col("_step") == 0) & (F.col("_rn") / F.col("_step") < k)).drop("_rn", "_step")


def even_sample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Rows int(i * n / k) of each group for i below k; all rows of a group of at most k."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    # Row rn is taken if some i has floor(i * n / k) = rn: the least i that reaches rn does.
    i = F.ceil(F.col("_rn") / (F.col("_n").cast("double") / k))
    near = lambda j: (j < k) & (F.floor(j * (F.col("_n").cast("double") / k)) == F.col("_rn"))
    return r.where((F.col("_n") <= k) | near(i) | near(i + 1) | near(F.greatest(i - 1, F.lit(0)))).drop("_rn", "_n")


def even_sample_large(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """even_sample for sequences too long for one task, with rank, a row's place in its sequence: places come from a numbering of all rows by range
    partitions, and a sequence is only counted."""
    placed = position(rows, [by, *order], "_all")
    span = placed.groupBy(by).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("_n"))
    step = F.col("_n").cast("double") / k
    wanted = F.when(F.col("_n") <= k, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step).cast("bigint")))
    chosen = span.select(by, "_first", F.explode(F.array_distinct(wanted)).alias("rank")).select((F.col("_first") + F.col("rank")).alias("_all"), "rank")
    return placed.join(chosen, "_all").drop("_all")


def first_per_key(rows: DataFrame, by: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def first_keys(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """All rows of the k keys that appear first: keys come from an aggregation and a top-k, not from a global window."""
    keys = rows.groupBy(key).agg(F.min(order).alias("_seen")).orderBy("_seen", key).limit(k).select(key)
    return rows.join(F.broadcast(keys), key, "left_semi")


def position(rows: DataFrame, order: list[str], name: str = "sample_idx") -> DataFrame:
    """Numbers rows from 0 in a global order without gathering them in one task: range partitions, written once, are numbered by themselves and
    shifted by the counts of those before, which are one row a partition. Counts and numbers come from the same written rows, since bounds that are
    sampled anew could differ. Of rows that are equal in order, any may come first."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    numbered = written(ordered.withColumns({"_part": part, "_at": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)}), "numbered")
    shift, total = [], 0
    for r in sorted(numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        shift.append((r["_part"], total))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(shift, "_part int, _shift bigint"))
    return numbered.join(before, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
