"""Prompts with images, as rows of parts: what a model is shown, in order, under budgets of images and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions import text


def assembled(samples: DataFrame, evidence: DataFrame, images: DataFrame, key: str, head: Column | None, tail: Column, most_images: int | None = None, most_chars: int | None = None, labels: bool = False) -> DataFrame:
    """key and parts, array<struct<kind, text, image>>: the head, the images in order (each after a label, if wanted), the tail.

    samples: key and what head and tail read, among it _evidence (the texts in order, array<string>), _n_images and _n_texts. evidence: key, ord,
    chunk_id, text, each cut to an equal share of most_chars. images: key, ord, chunk_id, ts, image; those without an image don't count, and at
    most so many are shown. A label names the image's time and the place of its chunk in the evidence. Samples without evidence or images
    have a head and a tail all the same."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "chunk_id"))
    placed = evidence.select(key, "ord", "chunk_id", "text", place.alias("_place"))
    seen = images.where("image is not null").select(key, "ord", "chunk_id", "ts", "image", F.row_number().over(Window.partitionBy(key).orderBy("ord", "image")).alias("_n"))
    seen = seen if most_images is None else seen.where(F.col("_n") <= most_images)
    shown = [F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("image").alias("image"))]
    if labels:
        # of several evidence texts of a chunk the last one names it
        seen = seen.join(placed.groupBy(key, "chunk_id").agg(F.max("_place").alias("_segment")), [key, "chunk_id"], "left")
        shown.insert(0, F.struct(F.lit("text").alias("kind"), text.image_label(F.col("ts"), F.col("_segment")).alias("text"), F.lit(None).cast("string").alias("image")))
    else:
        seen = seen.withColumn("_segment", F.lit(None).cast("int"))
    pictures = seen.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.array(*shown).alias("p")))), lambda s: s.p)).alias("_pictures"), F.count(F.lit(1)).alias("_n_images"))
    texts = placed.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "text"))), lambda s: s.text).alias("_evidence"))
    none = F.expr("cast(array() as array<string>)")
    rows = samples.join(texts, key, "left").join(pictures, key, "left").withColumns({"_evidence": F.coalesce("_evidence", none), "_n_images": F.coalesce("_n_images", F.lit(0))})
    if most_chars is not None:
        share = F.floor(F.lit(most_chars) / F.greatest(F.size("_evidence"), F.lit(1))).cast("int")
        rows = rows.withColumn("_evidence", F.transform("_evidence", lambda t: F.substring(t, F.lit(1), share)))
    rows = rows.withColumn("_n_texts", F.size("_evidence"))
    said = lambda c: F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), F.lit(None).cast("string").alias("image")))
    middle = F.coalesce("_pictures", F.expr("cast(array() as array<struct<kind:string,text:string,image:string>>)"))
    return rows.select(key, F.concat(*([said(head)] if head is not None else []), middle, said(tail)).alias("parts"))


def with_images(messages: DataFrame, images: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """messages: key, prompt -> key, parts: the images in order, then the prompt; the form for a verifier that may see frames."""
    none = messages.select(key, F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("chunk_id"), F.lit("").alias("text")).limit(0)
    return assembled(messages, none, images, key, None, F.col("prompt"), most)
