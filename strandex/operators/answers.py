"""What happens around an answer: result records, overrides by a known answer, evidence that is pruned, gated or put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import parsing
from strandex.functions.vector import dot, half_even, jaccard
from strandex.operators.sequence import Window, first_per_key


def result_key(benchmark: Column, video: Column, sample: Column, pipeline: str) -> Column:
    """The key by which a run is resumed."""
    return F.concat_ws("|", benchmark, video, sample.cast("string"), F.lit(pipeline))


def records(rows: DataFrame, pipeline: str) -> DataFrame:
    """rows: a sample's columns and what its run gave (answer, raw, evidence_chunk_ids, n_keyframes_to_answer, n_evidence_to_answer, trace_iters,
    elapsed, error); a run that failed has error and nothing else -> schemas.RESULT. The letter is the answer's first, else one read from the raw
    text; correct means that the chosen option's text is the gold one, so an empty gold is met by no answer."""
    options = F.coalesce("candidates", F.expr("array()").cast("array<string>"))
    ran = F.col("error").isNull()
    read = F.coalesce(parsing.answer_letter(F.coalesce("raw", F.lit("")), F.greatest(F.size(options), F.lit(1))), F.lit(""))
    said = F.coalesce("answer", F.lit(""))
    letter = F.when(~ran, "").otherwise(F.when(said != "", F.upper(F.substring(said, 1, 1))).otherwise(read))
    place = F.ascii(letter) - 65
    chosen = F.coalesce(F.when((letter != "") & (place >= 0) & (place < F.size(options)), F.get(options, place)), F.lit(""))
    return rows.select(
        result_key(F.col("benchmark"), F.col("video_id"), F.col("sample_idx"), pipeline).alias("key"), "benchmark", "question_type", "video_id", "sample_idx", F.lit(pipeline).alias("pipeline"), "question", "candidates", "gold_answer",
        letter.alias("pred_letter"), chosen.alias("pred_text"), (ran & (chosen == F.col("gold_answer"))).alias("correct"), F.coalesce("evidence_chunk_ids", F.expr("array()").cast("array<string>")).alias("evidence_chunk_ids"),
        "n_keyframes_to_answer", "n_evidence_to_answer", "trace_iters", half_even(F.col("elapsed"), 2).alias("elapsed"), "error",
    )


def in_range(rows: DataFrame, column: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the half-open range, by plain comparisons that reach the scan."""
    rows = rows if start is None else rows.where(F.col(column) >= start)
    return rows if end is None else rows.where(F.col(column) < end)


def against_gold(options: DataFrame, answers: DataFrame, key: str, option: str) -> DataFrame:
    """options: key, option, judgment; answers: key, answer, gold, label -> the same options under an override: where the answer is the gold one nothing
    is open and the sample is done; elsewhere the gold option is unknown, the others are false, and the sample isn't done. Without a gold
    option both stay as they are."""
    hit = F.col("answer") == F.col("gold")
    known = F.col("gold").isNotNull()
    both = options.join(answers, key)
    judged = F.when(known & ~hit, F.when(F.col(option) == F.col("gold"), "unknown").otherwise("false")).otherwise(F.col("judgment"))
    label = F.when(known & hit, "FULLY_SUFFICIENT").when(known, "INSUFFICIENT").otherwise(F.col("label"))
    return both.select(key, option, judged.alias("judgment"), label.alias("label"), (known & hit).alias("frozen"))


def pruned(evidence: DataFrame, flagged: DataFrame, key: str, order: list[str], keyframes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """evidence without the items whose places (from 1, in order) are flagged (key, place; others are ignored), and the keyframes (key, chunk_id) of what
    is left."""
    placed = evidence.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    left = placed.join(flagged.select(key, F.col("place").cast("bigint").alias("_place")).distinct(), [key, "_place"], "left_anti").drop("_place")
    return left, None if keyframes is None else keyframes.join(left.select(key, "chunk_id").distinct(), [key, "chunk_id"], "left_semi")


def chosen_ids(said: Column, ids: Column) -> tuple[Column, Column]:
    """(ids of a reply's first array that are among ids, status): fail where the reply has no array, ok else, and without evidence."""
    found = parsing.integers(said)
    none = F.expr("array()").cast("array<bigint>")
    status = F.when(F.size(ids) == 0, "ok").when(found.isNull(), "fail").otherwise("ok")
    return F.when((F.size(ids) > 0) & found.isNotNull(), F.sort_array(F.array_intersect(found.cast("array<bigint>"), ids))).otherwise(none), status


def gated(keyframes: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """keyframes: key, chunk_id; replies: key, ids, said -> the keyframes that the reply asks for; all of them where it can't be read."""
    ids, status = chosen_ids(F.col("said"), F.col("ids"))
    wanted = replies.select(key, ids.alias("_ids"), status.alias("status"))
    return keyframes.join(wanted, key).where((F.col("status") == "fail") | F.array_contains("_ids", F.col("chunk_id"))).drop("_ids")


def along_evidence(keyframes: DataFrame, evidence: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """keyframes: key, chunk_id and order; evidence: key, chunk_id, place -> keyframes in the order of their evidence, those without any last, with
    their rank, at most so many a key."""
    rows = keyframes.join(evidence.select(key, "chunk_id", "place").dropDuplicates([key, "chunk_id"]), [key, "chunk_id"], "left")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("place"), *order)).cast("bigint")).drop("place")
    return rows if most is None else rows.where(F.col("rank") <= most)


def frames_of(frames: DataFrame, by: list[str], name: str, sharpest: str, most: int) -> DataFrame:
    """Frames of each chunk, the sharpest first and the rest by name, at most so many."""
    return first_per_key(frames, by, [F.desc(sharpest), F.col(name)], most)


def selected(said: Column, n: Column, most: int) -> Column:
    """A listwise reranker's reply as array<struct<idx, score>>: the valid places it selects, in its order, at most so many, each 0.01 below the one
    before; without any the first places, all with score 1."""
    ids = F.try_variant_get(F.try_parse_json(F.regexp_extract(said, r"(?s)\{.*?\}", 0)), "$.selected", "array<int>")
    valid = F.slice(F.filter(ids, lambda i: (i >= 0) & (i < n)), 1, most)
    scored = F.transform(valid, lambda i, r: F.struct(i.cast("int").alias("idx"), F.round(1 - r * 0.01, 2).alias("score")))
    upto = F.least(n, F.lit(most))
    first = F.when(upto > 0, F.transform(F.sequence(F.lit(0), upto - 1), lambda i: F.struct(i.cast("int").alias("idx"), F.lit(1.0).alias("score")))).otherwise(F.expr("cast(array() as array<struct<idx:int,score:double>>)"))
    return F.when(F.size(F.coalesce(valid, F.expr("cast(array() as array<int>)"))) > 0, scored).otherwise(first)


def targeted_or_broadcast(queries: DataFrame, history: DataFrame, evidence: DataFrame, key: str, similar: float = 0.9, drift: float | None = 0.9) -> DataFrame:
    """queries: key, q_pos, tokens, q_vec; history: key, tokens; evidence: key, v -> queries with nearest_query, nearest_evidence, kept and the key's strategy:
    targeted while a query is kept that is like none asked before and not too near to what was found, else broadcast. Each side is folded to
    one row a key first, so a query meets its key's history and evidence once."""
    asked = history.groupBy(key).agg(F.collect_list("tokens").alias("_asked"))
    found = evidence.groupBy(key).agg(F.collect_list("v").alias("_found"))
    rows = queries.join(asked, key, "left").join(found, key, "left")
    near_query = F.round(F.array_max(F.transform("_asked", lambda t: jaccard(F.col("tokens"), t))), 6)
    near_found = F.round(F.array_max(F.transform("_found", lambda v: dot(F.col("q_vec"), v))), 6)
    rows = rows.select(key, "q_pos", near_query.alias("nearest_query"), near_found.alias("nearest_evidence"))
    kept = F.coalesce(F.col("nearest_query") < similar, F.lit(True))
    kept = kept if drift is None else kept & F.coalesce(F.col("nearest_evidence") < drift, F.lit(True))
    rows = rows.withColumn("kept", kept)
    return rows.withColumn("strategy", F.when(F.bool_or("kept").over(Window.partitionBy(key)), "targeted").otherwise("broadcast"))

