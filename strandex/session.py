"""Sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strandex", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, and streams' state on disk, as timers need it; everything else is left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
