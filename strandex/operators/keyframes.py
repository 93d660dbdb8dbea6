"""Keyframes: the frames that represent a window, and those that a question gathers over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions import text
from strandex.operators import dedup, sequence


def window_keyframes(frames: DataFrame, by: str, order: str, dark: Column, blurry: Column, sharpness: str, hash_: str, vector: str, theta: float, most_bits: int, look_back: int = 10, longest: int = 20, most: int = 2) -> DataFrame:
    """The keyframes of every window: by, idx (the window's number), order, local (from 0, in time) and name.

    frames: by, idx, order and what the other columns name. Dark frames go; then blurry ones, unless they are more than half of a window; then those
    whose hash is near to one of the last kept; what is left falls into runs of like neighbours, each represented by its sharpest frame (the first of
    equals); of these the sharpest stay (the last of equals, unknown sharpness counts as 0). Everything happens within a window, so one exchange
    by window serves all steps. A window without frames left has no rows."""
    group = ["_g"]
    rows = frames.where(~F.coalesce(dark, F.lit(True))).withColumn("_g", F.struct(by, "idx")).select("_g", order, sharpness, hash_, vector, blurry.alias("_blurry"))
    rows = sequence.unless_most(rows, group, F.col("_blurry"))
    rows = dedup.recent_hashes(rows, "_g", order, hash_, most_bits, look_back, carry=(sharpness, vector))
    rows = sequence.sessions(rows, "_g", [order], vector, theta, longest)
    best = F.struct(F.col(sharpness).isNotNull(), F.col(sharpness), -F.row_number().over(Window.partitionBy("_g").orderBy(order)))
    heads = rows.withColumn("_best", best).groupBy("_g", "raw_group").agg(F.max_by(F.struct(order, sharpness), "_best").alias("_f"))
    top = Window.partitionBy("_g").orderBy(F.desc(F.coalesce(F.col(f"_f.{sharpness}"), F.lit(0.0))), F.desc(f"_f.{order}"))
    kept = heads.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most)
    local = F.row_number().over(Window.partitionBy("_g").orderBy(f"_f.{order}")) - 1
    return kept.select("_g.*", F.col(f"_f.{order}").alias(order), local.alias("local")).withColumn("name", text.frame_name(F.col("idx"), F.col("local")))


def loadable(frames: DataFrame, by: list[str], order: list[str], loads: Column, most: int) -> DataFrame:
    """The first frames of each chunk, as many as the cap allows, and of those the ones that load."""
    return sequence.first_per_key(frames, by, order, most).where(F.coalesce(loads, F.lit(False)))


def accumulated(new: DataFrame, images: DataFrame, state: DataFrame | None, by: str, order: str, vector: str, threshold: float, chunk: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the images of new chunks that are unlike all that earlier ones had, with their chunk's order; the vectors to hold later rounds against).

    new: by, order, chunk, vector; images: chunk and more, only those that load; state: by, vector from the round before. A chunk whose vector is near to
    one in the state goes with all its images; one without a vector stays. A vector enters the state only if its chunk has an image."""
    have = images.select(*chunk).distinct().withColumn("_loads", F.lit(True))
    rows = new.join(have, chunk, "left")
    judged, state = dedup.carried(rows, state, by, order, vector, threshold, "_loads")
    kept = judged.where("_kept").select(by, order)
    return rows.where("_loads").join(kept, [by, order], "left_semi").select(by, order, *[c for c in chunk if c != by]).join(images, chunk), state
