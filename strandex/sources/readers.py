"""Readers of benchmarks, banks, subtitles and result files into the schemas of strandex.schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import schemas
from strandex.functions import text
from strandex.operators import sequence

#: Ids of upper layers are shifted by these (fixed values).
LAYER_OFFSET = {1: 0, 2: 100_000, 3: 200_000, 4: 300_000}
VIDEO_SUFFIXES = "{mp4,mkv,webm,avi,mov}"


# --- benchmarks ---------------------------------------------------------------------------------------------------


def entries(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """The entries of JSON files that hold one array each, with _source (the file) and _place (from 0, in the file). A file is read by one task."""
    files = spark.read.text(path, wholetext=True).withColumn("_source", F.input_file_name())
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return files.select("_source", F.posexplode(F.from_json("value", f"array<{kind}>")).alias("_place", "e")).select("_source", F.col("_place").cast("bigint").alias("_place"), "e.*")


def videomme(spark: SparkSession, path: str, durations: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Samples of the requested duration groups, numbered from 0 after that filter in the order of the file, options without their letters."""
    raw = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_source"), F.col("_metadata.row_index").alias("_place"))
    raw = raw.where(F.col("duration").isin(durations)) if durations else raw
    options = F.transform("options", text.without_option_prefix)
    out = sequence.position(raw, ["_source", "_place"]).select(
        F.lit("videomme").alias("benchmark"), "sample_idx", F.col("videoID").alias("video_id"), "question_id", F.col("task_type").alias("question_type"), "question",
        options.alias("candidates"), text.option_text(F.upper(F.trim("answer")), options).alias("gold_answer"), F.col("duration").alias("duration_group"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast("string").alias("video_path"),
    )
    return out.where(F.col("sample_idx") < most) if most else out


def mlvu(spark: SparkSession, folder: str, tasks: list[str] | None = None, videos: int | None = None, per_video: int | None = None) -> DataFrame:
    """Samples of one JSON array a task, numbered by their place in it; entries without candidates are left out. At most so many videos, those
    that come first (by task, as listed or else by name, then place), and so many questions a video."""
    raw = entries(spark, folder, schemas.MLVU).withColumn("task", text.stem(F.col("_source"))).where(F.col("candidates").isNotNull())
    raw = raw.where(F.col("task").isin(tasks)) if tasks else raw
    order = F.array_position(F.array(*map(F.lit, tasks)), F.col("task")) if tasks else F.col("task")
    rows = raw.withColumns({"video_id": text.stem(F.col("video")), "_seen": F.struct(order.alias("t"), F.col("_place").alias("p"))})
    rows = sequence.first_keys(rows, "video_id", "_seen", videos) if videos else rows
    rows = sequence.first_per_key(rows, ["video_id"], ["_seen"], per_video) if per_video else rows
    return rows.select(
        F.lit("mlvu").alias("benchmark"), F.col("_place").alias("sample_idx"), "video_id", F.lit(None).cast("string").alias("question_id"), F.col("task").alias("question_type"), "question", "candidates",
        F.coalesce("answer", F.lit("")).alias("gold_answer"), F.lit(None).cast("string").alias("duration_group"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.concat_ws("/", "task", "video").alias("video_path"),
    )


def long_video(spark: SparkSession, path: str, durations: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Samples of the requested duration groups, numbered from 0 after that filter in the order of the file."""
    raw = entries(spark, path, schemas.LONG_VIDEO)
    raw = raw.where(F.col("duration_group").isin(durations)) if durations else raw
    out = sequence.position(raw, ["_source", "_place"]).select(
        F.lit("longvideobench").alias("benchmark"), "sample_idx", text.stem(F.col("video_path")).alias("video_id"), F.lit(None).cast("string").alias("question_id"), F.coalesce("question_category", F.lit("")).alias("question_type"), "question", "candidates",
        F.coalesce(F.get("candidates", F.col("correct_choice")), F.lit("")).alias("gold_answer"), F.coalesce("duration_group", F.lit(0)).cast("string").alias("duration_group"), F.coalesce("duration", F.lit(0.0)).alias("duration"), "video_path",
    )
    return out.where(F.col("sample_idx") < most) if most else out


def jsonl(spark: SparkSession, path: str | list[str], schema, permissive: bool = False) -> DataFrame:
    """One JSON object a line, blank lines skipped. permissive: malformed lines are dropped, else they fail. Adds _source, the file."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if permissive else "FAILFAST").json(path).withColumn("_source", F.input_file_name())


def video_filter(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, "video_id string", permissive=True).where("video_id is not null").select("video_id").distinct()


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """video_id and path of every video below a folder; of several files for an id the first by path. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{VIDEO_SUFFIXES}").load(folder).select("path", "length")
    return sequence.first_per_key(found.withColumn("video_id", text.stem(F.col("path"))), ["video_id"], ["path"])


def videos(spark: SparkSession, path: str) -> DataFrame:
    """video_id and path of one video, of those that a list names (a .txt file, a path a line, blank lines skipped), or of all below a folder."""
    if path.endswith(".txt"):
        named = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    elif path.rsplit(".", 1)[-1] in VIDEO_SUFFIXES.strip("{}").split(","):
        named = spark.createDataFrame([(path,)], "path string")
    else:
        return video_files(spark, path).select("path", "video_id")
    return named.withColumn("video_id", text.stem(F.col("path")))


# --- subtitles ----------------------------------------------------------------------------------------------------

STAMP = r"^(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def subtitles_native(files: DataFrame) -> DataFrame:
    """Cues of texts of SRT files (video_id, value), well-formed or not.

    A time line opens a cue and numbers the lines up to the next one; of these its text is what comes before the first blank line that follows any text.
    Lines of digits alone aren't text, tags go, cues without text are left out and the others numbered from 0."""
    lines = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    rows = files.select("video_id", F.posexplode(lines).alias("_n", "_line")).withColumn("_line", F.regexp_replace("_line", r"^[\s\ufeff]+|\s+$", ""))
    rows = rows.withColumn("_time", F.col("_line").rlike(STAMP))
    in_file = sequence.Window.partitionBy("video_id").orderBy("_n")
    rows = rows.withColumn("_cue", F.sum(F.col("_time").cast("int")).over(in_file)).where("_cue > 0")
    rows = rows.withColumn("_text", ~F.col("_time") & (F.col("_line") != "") & ~F.col("_line").rlike(r"^\d+$"))
    before = sequence.Window.partitionBy("video_id", "_cue").orderBy("_n").rowsBetween(sequence.Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ends", (F.col("_line") == "") & F.coalesce(F.bool_or("_text").over(before), F.lit(False)))
    rows = rows.withColumn("_text", F.col("_text") & ~F.coalesce(F.bool_or("_ends").over(before), F.lit(False)))
    head = F.max(F.when(F.col("_time"), F.col("_line")))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_text"), F.struct("_n", "_line")))), lambda s: s["_line"]), " ")
    cues = rows.groupBy("video_id", "_cue").agg(head.alias("_head"), F.trim(text.strip_tags(said)).alias("text")).where("text <> ''")
    at = lambda i: text.srt_seconds(F.regexp_extract("_head", STAMP, i))
    number = F.row_number().over(sequence.Window.partitionBy("video_id").orderBy("_cue")) - 1
    return cues.select("video_id", number.alias("cue_idx"), at(1).alias("start_s"), at(2).alias("end_s"), "text")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all SRT files at a path, the file's stem as video_id."""
    files = spark.read.option("pathGlobFilter", "*.srt").text(path, wholetext=True)
    return subtitles_native(files.select(text.stem(F.input_file_name()).alias("video_id"), "value"))


# --- banks --------------------------------------------------------------------------------------------------------


def _as_chunks(rows: DataFrame, **columns: Column) -> DataFrame:
    have = {**{c: F.col(c) for c in rows.columns}, **columns}
    return rows.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CHUNK])


def bank_files(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Chunks of all layers of banks: one document a file, or one a line as save_banks writes them."""
    banks = spark.read.schema(schemas.BANK).option("multiLine", not one_a_line).json(path)
    rows = None
    for k, c in ((1, "chunks"), (2, "l2_chunks"), (3, "l3_chunks"), (4, "l4_chunks")):
        layer = banks.select("video_id", F.lit(k).alias("layer"), F.explode(c).alias("c")).select("video_id", "layer", "c.*")
        rows = layer if rows is None else rows.unionByName(layer)
    return _as_chunks(rows, idx=F.col("chunk_id"))


def arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Matrices of NPZ files in long form: folder (the parent's name), name, row, v. One file is read by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for folder, body in zip(p["folder"], p["content"], strict=True):
                with np.load(io.BytesIO(body)) as z:
                    for name in names:
                        if name in z:
                            m = np.asarray(z[name], np.float64)
                            m = m.reshape(len(m), -1)
                            yield pd.DataFrame({"folder": folder, "name": name, "row": np.arange(len(m)), "v": list(m)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "content").mapInPandas(run, "folder string, name string, row bigint, v array<double>")


def legacy_banks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of narrative.json joined to vectors.npz by (video, chunk id): a chunk without a vector stays."""
    raw = spark.read.schema(schemas.NARRATIVE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "narrative.json").json(folder)
    rows = raw.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)).select("folder", "video_id", F.explode("chunks").alias("c")).select("folder", "video_id", "c.*")
    z = arrays(spark, folder, ["chunk_ids", "narrative_vecs", "visual_vecs"])
    of = lambda name, column: z.where(F.col("name") == name).select("folder", "row", F.col("v").alias(column))
    ids = of("chunk_ids", "_id").select("folder", "row", F.get("_id", F.lit(0)).cast("bigint").alias("chunk_id"))
    vectors = ids.join(of("narrative_vecs", "v_dynamic"), ["folder", "row"], "left").join(of("visual_vecs", "_visual"), ["folder", "row"], "left").drop("row")
    joined = rows.join(vectors, ["folder", "chunk_id"], "left")
    memory = F.when(F.coalesce(F.trim("narrative"), F.lit("")) != "", F.col("narrative")).otherwise(F.array_join("caption", " | "))
    return _as_chunks(joined, layer=F.lit(1), idx=F.col("chunk_id"), memory_text=memory, asr=F.coalesce("speech_text", F.lit("")), v_visual=F.coalesce(F.col("_visual"), F.col("visual_vec").cast("array<double>")), video_id=F.coalesce("video_id", "folder"))


def pyramid_text(layer: int, start: Column, end: Column, said: Column, timeline: Column) -> Column:
    """An upper row as evidence: its layer and times, its text, its timeline."""
    head = F.concat(F.lit(f"[L{layer}]"), text.time_head(start, end), F.lit(" "), said)
    return F.when(F.size(timeline) > 0, F.concat(head, F.lit("\nTimeline: "), F.array_join(timeline, " → "))).otherwise(head)


def pyramid_banks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of L1.jsonl to L4.jsonl with vectors inline. Rows and vectors meet by the row's place in the file, which the writer keeps in
    step (idx counts windows, and windows without frames have no row). A window that names no frame has a visual vector of zeros."""
    file = lambda k: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"L{k}.jsonl")
    place = lambda df: df.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    number = lambda df: df.withColumn("row", F.row_number().over(sequence.Window.partitionBy("folder").orderBy("idx")).cast("bigint") - 1)
    z = arrays(spark, folder, [f"L{k}_text" for k in range(1, 5)] + ["L1_visual"])
    first = number(place(file(1).schema(schemas.PYRAMID_L1).json(folder)))
    visual = first.select("folder", "row", F.explode("visual_offsets").alias("at")).join(z.where("name = 'L1_visual'").select("folder", F.col("row").alias("at"), "v"), ["folder", "at"])
    pooled = visual.select("folder", "row", F.posexplode("v")).groupBy("folder", "row", "pos").agg(F.avg("col").alias("x")).groupBy("folder", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v_visual"))
    out = None
    for k in range(1, 5):
        rows = first if k == 1 else number(place(file(k).schema(schemas.PYRAMID_UPPER).json(folder)))
        vec = z.where(F.col("name") == f"L{k}_text").select("folder", "row", F.col("v").alias("v_dynamic"))
        rows = rows.join(vec, ["folder", "row"], "left")
        if k == 1:
            width = z.where("name = 'L1_visual'").groupBy("folder").agg(F.max(F.size("v")).alias("_width"))
            none = F.when(F.col("_width").isNotNull(), F.array_repeat(F.lit(0.0), F.col("_width")))
            rows = rows.join(pooled, ["folder", "row"], "left").join(width, "folder", "left").withColumn("v_visual", F.coalesce("v_visual", none))
            own = {"keyframe_path": F.get("frame_paths", F.lit(0)), "keyframe_ts": F.get("frame_ts", F.lit(0)), "sampled_frames": F.col("frame_ts"), "memory_text": F.col("text")}
        else:
            own = {"memory_text": pyramid_text(k, F.col("t_start"), F.col("t_end"), F.col("text"), F.col("timeline"))}
        rows = _as_chunks(rows, video_id=F.col("folder"), layer=F.lit(k), chunk_id=F.col("idx") + LAYER_OFFSET[k], start_time=F.col("t_start"), end_time=F.col("t_end"), asr=F.lit(""), **own)
        out = rows if out is None else out.unionByName(rows)
    return out


def kind_of(spark: SparkSession, path: str) -> tuple[str, str]:
    """(kind, path) of the bank at a path: a file; a folder with L1.jsonl is a pyramid, any other with narrative.json a legacy one; else the JSON file
    beside it that has its name."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p))
    if fs.exists(root) and fs.getFileStatus(root).isFile():
        return "file", path
    folder = path.rstrip("/")
    for name, kind in (("L1.jsonl", "pyramid"), ("narrative.json", "legacy")):
        if there(f"{folder}/{name}"):
            return kind, folder
    if there(f"{folder}.json"):
        return "file", f"{folder}.json"
    raise ValueError(f"no bank at {path}")


def bank(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Chunks of a bank, or of a collection of banks of one kind: file, lines, legacy or pyramid. Without a kind, what is at the path tells it."""
    if kind is None:
        kind, path = kind_of(spark, path)
    return {"file": bank_files, "lines": lambda s, p: bank_files(s, p, True), "legacy": legacy_banks, "pyramid": pyramid_banks}[kind](spark, path)


#: Folders of frames below a video's, the one to prefer and the one of older banks; names of frames by chunk, and in pyramids (fixed values).
FRAME_FOLDERS, FRAME_NAMES = ("keyframes_origin", "frames"), (r"^(\d{4,})_.*\.jpg$", r"^c(\d{5,})_f.*\.jpg$")


def frame_files(spark: SparkSession, folder: str, preferred: str = FRAME_FOLDERS[0]) -> DataFrame:
    """video_id, chunk_id and path of every frame below {folder}/{video}/{preferred}, or the older folder where a video lacks that one. A chunk's frames are
    named by its number; only where it has none do names as pyramids give them count. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(folder).select("path")
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    rows = found.select("path", part(3).alias("video_id"), part(2).alias("_folder"), part(1).alias("_name")).where(F.col("_folder").isin(preferred, FRAME_FOLDERS[1]))
    number = [F.nullif(F.regexp_extract("_name", n, 1), F.lit("")).cast("bigint") for n in FRAME_NAMES]
    rows = rows.withColumns({"chunk_id": F.coalesce(*number), "_scheme": F.when(number[0].isNotNull(), 0).otherwise(1), "_older": (F.col("_folder") != preferred).cast("int")}).where("chunk_id is not null")
    least = lambda column, *by: F.min(column).over(sequence.Window.partitionBy(*by))
    rows = rows.where(F.col("path").isNotNull()).withColumn("_first", least("_older", "video_id")).where("_older = _first").withColumn("_first", least("_scheme", "video_id", "chunk_id")).where("_scheme = _first")
    return rows.select("video_id", "chunk_id", "path")


def keyframes(chunks: DataFrame, frames: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """The path of each chunk's keyframe: from frames (video_id, chunk_id, path), else from a fallback of the same columns."""
    out = chunks.join(frames.withColumnRenamed("path", "_a"), ["video_id", "chunk_id"], "left")
    if fallback is None:
        return out.withColumnRenamed("_a", "path")
    return out.join(fallback.withColumnRenamed("path", "_b"), ["video_id", "chunk_id"], "left").withColumn("path", F.coalesce("_a", "_b")).drop("_a", "_b")
