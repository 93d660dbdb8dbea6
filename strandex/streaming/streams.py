"""Streaming forms: tumbling windows with a watermark, similarity sessions as state that ends, exactly-once append of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A bounded queue of files: so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_counts(events: DataFrame, ts: str, span: str, late: str, by: list[str]) -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out, state older than it is dropped."""
    w = F.window(ts, span)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("t_start"), *by, "n")


class Sessions(StatefulProcessor):
    """A key's last vector, group, group's length, last place and opening time; a timer lets go of it."""

    STATE = "last array<double>, grp bigint, size bigint, place bigint, opened bigint"

    def __init__(self, by: str, order: str, vector: str, ts: str, theta: float, longest: int, idle_ms: int):
        self.by, self.order, self.vector, self.ts, self.theta, self.longest, self.idle_ms = by, order, vector, ts, theta, longest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last, group, size, place, opened = self.held.get() if self.held.exists() else ([], -1, 0, None, None)
        out, latest = [], 0
        for at, v, ts in zip(frames[self.order], frames[self.vector], frames[self.ts], strict=True):
            if place is not None and at <= place:
                continue
            ms = int(ts.timestamp() * 1000)
            v = np.asarray(v, float)
            if group < 0 or size >= self.longest or float(v @ np.asarray(last)) < self.theta:
                group, size = group + 1, 0
            last, size, place, opened, latest = v.tolist(), size + 1, int(at), ms if opened is None else opened, max(latest, ms)
            out.append((key[0], at, group, pd.Timestamp(opened, unit="ms")))
        if out:
            self.held.update((last, group, size, place, opened))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.idle_ms)
            yield pd.DataFrame(out, columns=[self.by, self.order, "raw_group", "opened"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def sessions(frames: DataFrame, by: str, order: str, vector: str, theta: float, longest: int, ts: str, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """by, order, raw_group and opened (the time of the key's first frame) of frames that arrive in order within each key.

    State is one vector a key, and is dropped once the watermark (late behind the latest time seen) has passed the key's last frame by idle_ms. Frames
    older than the watermark, and frames that don't come after the last one of their key, are left out; a key that comes back after its state was
    dropped begins anew with group 0 and a later `opened`."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, raw_group bigint, opened timestamp"
    processor = Sessions(by, order, vector, ts, theta, longest, idle_ms)
    return frames.withWatermark(ts, late).groupBy(by).transformWithStateInPandas(processor, schema, "append", "EventTime")


def append_new(results: DataFrame, path: str, key: str, checkpoint: str, ts: str | None = None, keep: str = "7 days"):
    """Appends results to Parquet, each key once. Keys are remembered in state for as long as `keep` behind the latest time (of ts, else of arrival), and the
    sink's own log lets a batch that is run again add nothing; so a batch costs what it holds, not what was written before. A key that comes back
    later than that is written again."""
    rows = results if ts else results.withColumn("_at", F.current_timestamp())
    once = rows.withWatermark(ts or "_at", keep).dropDuplicatesWithinWatermark([key]).drop("_at")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
