"""Sinks: banks, layers, results. Spark's writers commit whole tasks, so a lost executor leaves no half-written row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandex import schemas
from strandex.operators.verdict import layer_counts


def save_banks(chunks: DataFrame, path: str) -> None:
    """One JSON document a video, chunks in order. A document is as long as its video; parquet (save_layers) is the form to prefer."""
    fields = [f.name for f in schemas.BANK_CHUNK]
    of = lambda k: F.transform(F.sort_array(F.filter(F.collect_list(F.struct("layer", "chunk_id", F.struct(*fields).alias("c"))), lambda x: x.layer == k)), lambda x: x.c)
    docs = chunks.groupBy("video_id").agg(F.coalesce(F.max("end_time"), F.lit(0.0)).alias("duration"), of(1).alias("chunks"), of(2).alias("l2_chunks"), of(3).alias("l3_chunks"), of(4).alias("l4_chunks"))
    docs.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_part(part: DataFrame, path: str, name: str) -> dict:
    """Writes a part of a bank (a layer, or the frames' vectors) under a folder of its own and then commits it: its manifest is written aside and renamed. A
    part counts only with its manifest, which names the folder, so a write that dies leaves nothing that is read, and one that is tried again never
    mixes with it. Of two writers the one that commits last counts."""
    spark = part.sparkSession
    folder = f"data/{name}-{uuid.uuid4().hex}"
    part.write.parquet(f"{path}/{folder}")
    manifest = {"name": name, "folder": folder, "rows": spark.read.schema(part.schema).parquet(f"{path}/{folder}").count(), "schema": part.schema.jsonValue()}
    fs, aside = _fs(spark, f"{path}/manifests/.{name}-{uuid.uuid4().hex}")
    _, final = _fs(spark, f"{path}/manifests/{name}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(aside, final):
        raise OSError(f"{name} was not committed at {path}")
    return manifest


def manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """The committed parts by name: a few small files."""
    fs, root = _fs(spark, f"{path}/manifests")
    if not fs.exists(root):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    wanted = [f"{path}/manifests/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
    return {m["name"]: m for m in (json.loads(r.value) for r in spark.read.text(wanted, wholetext=True).collect())} if wanted else {}


def load_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A committed part; columns that aren't asked for aren't read. A part without rows has its schema all the same."""
    m = manifests(spark, path)[name]
    return spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{path}/{m['folder']}")


def save_layers(chunks: DataFrame, path: str, layers: list[int] | None = None) -> None:
    """Chunks with their vectors inline, a part a layer: the layers that have rows, or those that are named, with or without rows."""
    for k in layers or sorted(r.layer for r in chunks.select("layer").distinct().collect()):
        save_part(chunks.where(F.col("layer") == k), path, f"L{k}")


def save_visual(frames: DataFrame, path: str) -> None:
    """The frames' vectors: video_id, idx (their window), frame, ts, v_visual."""
    save_part(frames.select("video_id", "idx", "frame", "ts", "v_visual"), path, "visual")


def done_layers(spark: SparkSession, path: str) -> set[int]:
    """Layers that are committed; folders without a manifest don't count."""
    return {int(n[1:]) for n in manifests(spark, path) if n[:1] == "L" and n[1:].isdigit()}


def resumed(spark: SparkSession, path: str, steps: dict[str, Callable[[], DataFrame]]) -> list[str]:
    """Builds the parts that aren't committed yet, in order, and returns their names. A step may read what earlier ones committed, by load_part."""
    done, built = manifests(spark, path), []
    for name, step in steps.items():
        if name not in done:
            save_part(step(), path, name)
            built.append(name)
    return built


def save_meta(chunks: DataFrame, path: str, status: str = "complete") -> None:
    layer_counts(chunks, "video_id").withColumn("status", F.lit(status)).write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str, form: str = "json") -> None:
    results.write.mode("append").format(form).save(path)
