"""Retrieval plans: one-shot, two-stage, multi-pool, coarse-to-fine, and the bounded loop of plan, retrieve, dedup and verify.

All questions go through a round together: a round is a few joins and aggregations over tables keyed by question, and finished questions leave
by an anti-join. The loop on the driver only counts rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import text
from strandex.functions.vector import tokens
from strandex.operators import answers as overrides
from strandex.operators import dedup, keyframes, retrieval, sequence, verdict
from strandex.plans import providers
from strandex.scratch import written

KEY = "sample_key"


def question_text(question: Column, candidates: Column) -> Column:
    return F.concat(question, F.lit("\nChoices:\n"), text.option_lines(candidates))


def coarse_rag(samples: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], k: int = 8, visual: Callable[[Column], Column] | None = None, alpha: float = 0.6) -> DataFrame:
    """The k nearest chunks of each question; samples without a bank give no rows. With visual, image scores are fused where a chunk has a vector."""
    q = samples.select(KEY, "video_id", embed(F.col("query")).alias("q_vec"), *([visual(F.col("query")).alias("vis_vec")] if visual else []))
    if not visual:
        return retrieval.nearest(q, chunks, "video_id", [KEY], k).select(KEY, "chunk_id", "score", "rank")

    def fused(text_score, seen):
        both = retrieval.half_up(alpha * text_score + (1 - alpha) * seen, retrieval.DIGITS)
        return np.where(np.isnan(seen), text_score, both)

    return retrieval.nearest(q, chunks, "video_id", [KEY], k, (("q_vec", "v_dynamic"), ("vis_vec", "v_visual")), fused).select(KEY, "chunk_id", "score", "rank")


def coarse_answers(samples: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], k: int = 8, how: Loop | None = None, models: Providers | None = None, images: DataFrame | None = None) -> DataFrame:
    """One search a question, with its options in the query, and an answer from what it finds, in order of use if wanted: sample_key, answer, n_evidence,
    evidence and keyframes as run_loop gives them. Samples whose video has no chunks are answered without evidence."""
    how, models = how or Loop(most_keyframes=8, visual_similarity=0.92), models or Providers()
    asked = samples.withColumn("query", question_text(F.col("question"), F.col("candidates")))
    top = coarse_rag(asked, chunks, embed, k).withColumn("ord", F.struct(F.lit(0).alias("round"), F.lit(0).alias("q_pos"), F.col("rank")))
    found = written(top.join(samples.select(KEY, "video_id"), KEY).join(chunks.select("video_id", "chunk_id", F.col("memory_text").alias("text"), *(["v_visual"] if "v_visual" in chunks.columns else [])), ["video_id", "chunk_id"]), "found")
    options = options_of(samples)
    judged = models.judge(options, found, KEY)
    said = judged.groupBy(KEY).agg(F.max_by("opt", F.struct((F.col("said") == "true").cast("int"), F.col("rubric_score"))).alias("answer"))
    counts = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_evidence"))
    answers = samples.select(KEY).join(said, KEY, "left").join(counts, KEY, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    if images is None or "v_visual" not in chunks.columns:
        frames = found.select(KEY, "ord", "chunk_id", F.lit("").alias("image")).limit(0)
    else:
        images = sequence.first_per_key(images, ["video_id", "chunk_id"], ["image"], how.images_a_chunk)
        frames, _ = keyframes.accumulated(found.select(KEY, "ord", "video_id", "chunk_id", "v_visual"), images, None, KEY, "ord", "v_visual", how.visual_similarity, ["video_id", "chunk_id"])
        frames = frames.select(KEY, "ord", "chunk_id", "image")
    return as_shown(answers, samples, found.select(KEY, "ord", "chunk_id", "text"), frames, how, models)


def rerank_rag(samples: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], score: Callable[[Column, Column], Column], coarse: int = 50, final: int = 10) -> DataFrame:
    q = samples.select(KEY, "video_id", "query", embed(F.col("query")).alias("q_vec"))
    first = retrieval.nearest(q, chunks, "video_id", [KEY], coarse, rank="coarse_rank")
    pairs = first.join(q.select(KEY, "query"), KEY).join(chunks.select("video_id", "chunk_id", "memory_text"), ["video_id", "chunk_id"])
    second = pairs.withColumn("rerank_score", score(F.col("query"), F.col("memory_text")))
    return retrieval.top_k(second, [KEY], final, score="rerank_score").select(KEY, "chunk_id", "score", "rerank_score", "rank")


def timeline(samples: DataFrame, chunks: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """Chunks spread evenly over each question's video, those already seen left out first."""
    rows = samples.select(KEY, "video_id").join(chunks, "video_id")
    rows = retrieval.unseen(rows, seen, [KEY, "chunk_id"]) if seen is not None else rows
    return sequence.stride_sample(rows, [KEY], ["start_time", "chunk_id"], k)


def best_context(samples: DataFrame, windows: DataFrame, embed: Callable[[Column], Column], k: int = 3) -> DataFrame:
    """The k nearest upper windows of each question as one text, best first."""
    top = coarse_rag(samples, windows, embed, k).join(windows.select("chunk_id", "memory_text"), "chunk_id")
    return top.groupBy(KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "memory_text"))), lambda s: s.memory_text), "\n").alias("context"))


@dataclass
class Loop:
    """Settings of the loop; the ablations are settings too."""

    max_rounds: int = 3
    top_k: int = 8
    evidence_similarity: float = 0.9
    threshold: float = 0.75  # of samples without a threshold of their own
    margin: float = 0.2
    most_evidence: int = 32
    single_query: bool = False  # the first round asks the question only
    judge_by_rubric: bool = True  # else the judge's word counts without a threshold
    ignore_verifier: bool = False  # later rounds ask the question again
    oracle: bool = False  # the gold answer overrides the verdict: met, the sample is done; missed, its option is unknown and the others false
    query_similarity: float = 0.9  # later queries that are so like one asked before go
    query_drift: float | None = 0.9  # and those that are so near to what was found
    repeat_queries: bool = False  # neither filter
    visual_similarity: float = 0.9
    images_a_chunk: int = 1
    most_keyframes: int = 16
    prune: bool = False  # evidence that is called a distractor goes after its round, with its keyframes
    rerank: bool = False  # the answer's evidence, and its keyframes with it, in order of use; else as found
    answer_evidence: int | None = None
    text_first: bool = False  # the answer sees only keyframes of chunks that a reply to the texts asks for


@dataclass
class Providers:
    """The models' parts, each a function of tables; lexical stand-ins by default."""

    judge: Callable = providers.lexical_judge
    distractors: Callable = providers.lexical_distractors
    order: Callable = providers.lexical_order
    asks: Callable = providers.lexical_asks
    plan: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def options_of(samples: DataFrame) -> DataFrame:
    return samples.select(KEY, F.posexplode("candidates").alias("i", "candidate")).select(KEY, text.letter(F.col("i")).alias("opt"), "candidate")


def first_queries(samples: DataFrame, how: Loop) -> DataFrame:
    """The question, then one query an option."""
    q = F.array("question") if how.single_query else F.concat(F.array("question"), text.grounded_queries(F.col("question"), F.col("candidates")))
    return samples.select(KEY, "video_id", F.posexplode(q).alias("q_pos", "query"))


def next_queries(samples: DataFrame, options: DataFrame, how: Loop) -> DataFrame:
    """One query for each option that is still unknown; the question itself where there is none or the verifier is ignored."""
    if how.ignore_verifier:
        return samples.select(KEY, "video_id", F.lit(0).alias("q_pos"), F.col("question").alias("query"))
    open_ = options.where("judgment = 'unknown'").groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("opt", "candidate"))).alias("o"))
    q = F.coalesce(F.transform("o", lambda x: F.concat(F.lit("Evidence for ("), x.opt, F.lit(") "), x.candidate)), F.array("question"))
    return samples.join(open_, KEY, "left").select(KEY, "video_id", F.posexplode(q).alias("q_pos", "query"))


def found_by(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each query: ids and vectors are scored, and only the winners get their texts."""
    top = retrieval.nearest(asked, chunks, "video_id", [KEY, "q_pos"], k)
    return top.join(chunks.select("video_id", "chunk_id", "v_dynamic", "memory_text"), ["video_id", "chunk_id"])


def broadcast_found(samples: DataFrame, chunks: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Chunks spread over the videos of samples whose queries were all dropped, in the form of found_by."""
    rows = timeline(samples, chunks.withColumn("start_time", F.col("start_time") if "start_time" in chunks.columns else F.col("chunk_id").cast("double")), seen, k)
    rank = F.row_number().over(sequence.Window.partitionBy(KEY).orderBy("start_time", "chunk_id"))
    return rows.select("video_id", "chunk_id", KEY, F.lit(0).alias("q_pos"), F.lit(0.0).alias("score"), rank.alias("rank"), "v_dynamic", "memory_text")


def as_shown(answers: DataFrame, samples: DataFrame, evidence: DataFrame, frames: DataFrame, how: Loop, models: Providers) -> DataFrame:
    """answers with what the answer was given: the ids of its evidence and its keyframes, both in order. frames: sample, ord, chunk_id, image."""
    found = F.row_number().over(sequence.Window.partitionBy(KEY).orderBy("ord"))
    placed = (models.order(samples, evidence, KEY) if how.rerank else evidence).withColumn("place", F.col("place") if how.rerank else found)
    placed = placed if how.answer_evidence is None else placed.where(F.col("place") <= how.answer_evidence)
    seen = overrides.along_evidence(frames, placed, KEY, ["ord", "image"])
    if how.text_first:
        seen = overrides.gated(seen, models.asks(answers, samples, placed, KEY), KEY)
        seen = seen.withColumn("rank", F.row_number().over(sequence.Window.partitionBy(KEY).orderBy("rank")).cast("bigint"))
    seen = seen.where(F.col("rank") <= how.most_keyframes)
    in_order = lambda at, x: F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda s: s[x])
    ids = placed.groupBy(KEY).agg(in_order("place", "chunk_id").alias("evidence"))
    images = seen.groupBy(KEY).agg(in_order("rank", "image").alias("keyframes"))
    none = lambda c: F.coalesce(c, F.expr("cast(array() as array<bigint>)") if c == "evidence" else F.expr("cast(array() as array<string>)")).alias(c)
    return answers.join(ids, KEY, "left").join(images, KEY, "left").select(*answers.columns, none("evidence"), none("keyframes"))


def run_loop(samples: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], how: Loop | None = None, models: Providers | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """samples: sample_key, video_id, question, candidates, gold and, if there, threshold; chunks: video_id, chunk_id, memory_text, v_dynamic and, if there,
    v_visual, start_time; images: video_id, chunk_id, image (in order), only those that load; without them each chunk with a v_visual column has one.

    Each round asks its queries (from the second on, those that are neither like an earlier one nor near to what was found; where none is left, chunks
    spread over the video are taken), adds what is new and not near to the evidence, and with it the keyframes that are unlike those of earlier rounds,
    judges, and prunes. models.plan(live samples, judged options) gives the queries of later rounds (sample_key, video_id, q_pos, query); without it
    they follow from the options that are unknown.

    Returns (answers: sample_key, answer, label, rounds, n_evidence, n_keyframes, evidence, keyframes; trace: a row a question and round)."""
    how, models = how or Loop(), models or Providers()
    spark = samples.sparkSession
    options = options_of(samples)
    limits = samples.select(KEY, F.col("threshold") if "threshold" in samples.columns else F.lit(how.threshold).alias("threshold"))
    if images is None and "v_visual" in chunks.columns:
        images = chunks.select("video_id", "chunk_id", F.col("chunk_id").cast("string").alias("image"))
    if images is not None:
        images = sequence.first_per_key(images, ["video_id", "chunk_id"], ["image"], how.images_a_chunk)
    queries, live = first_queries(samples, how), samples
    evidence = seen = trace = history = frames = None
    answers, used, shown = [], [], []
    for i in range(how.max_rounds):
        asked = queries.withColumn("q_vec", embed(F.col("query"))).withColumn("tokens", tokens(F.col("query")))
        if i and not how.repeat_queries:
            plans = overrides.targeted_or_broadcast(asked, history, evidence.select(KEY, F.col("v_dynamic").alias("v")), KEY, how.query_similarity, how.query_drift)
            plans = written(asked.join(plans.select(KEY, "q_pos", "kept", "strategy"), [KEY, "q_pos"]), "plan")
            asked, strategy = plans.where("kept").select(*asked.columns), plans.select(KEY, "strategy").distinct()
        else:
            asked, strategy = written(asked, "plan"), live.select(KEY, F.lit("targeted").alias("strategy"))
        found = found_by(asked, chunks, how.top_k)
        if seen is not None:
            found = retrieval.unseen(found, seen, [KEY, "chunk_id"])
            if not how.repeat_queries:
                idle = live.join(strategy.where("strategy = 'broadcast'"), KEY, "left_semi")
                found = found.unionByName(broadcast_found(idle, chunks, seen, how.top_k).select(*found.columns))
        was = asked.select(KEY, "tokens") if history is not None else asked.select(KEY, "tokens").unionByName(samples.select(KEY, tokens(F.col("question")).alias("tokens")))
        history = was if history is None else history.unionByName(was)
        new = retrieval.first_seen(found, [KEY]).select(KEY, F.struct(F.lit(i).alias("round"), "q_pos", "rank").alias("ord"), "video_id", "chunk_id", F.col("memory_text").alias("text"), "v_dynamic")
        pool = new if evidence is None else evidence.join(live.select(KEY), KEY, "left_semi").unionByName(new)
        pool = written(pool, "pool")
        kept = dedup.greedy_similarity(pool, KEY, "ord", "v_dynamic", how.evidence_similarity)
        evidence = written(sequence.first_per_key(pool.join(kept, [KEY, "ord"], "left_semi"), [KEY], ["ord"], how.most_evidence), "evidence")
        seen = pool.select(KEY, "chunk_id") if seen is None else seen.unionByName(pool.select(KEY, "chunk_id"))
        if images is not None:
            visual = chunks.select("video_id", "chunk_id", "v_visual") if "v_visual" in chunks.columns else chunks.select("video_id", "chunk_id", F.lit(None).cast("array<double>").alias("v_visual"))
            state = frames.select(KEY, "video_id", "chunk_id").distinct().join(visual.where("size(v_visual) > 0"), ["video_id", "chunk_id"]).select(KEY, "v_visual") if frames is not None else None
            latest = evidence.where(F.col("ord.round") == i).select(KEY, "ord", "video_id", "chunk_id").join(visual, ["video_id", "chunk_id"])
            added, _ = keyframes.accumulated(latest, images, state, KEY, "ord", "v_visual", how.visual_similarity, ["video_id", "chunk_id"])
            added = added.select(KEY, "ord", "video_id", "chunk_id", "image")
            frames = added if frames is None else frames.join(live.select(KEY), KEY, "left_semi").unionByName(added)
            frames = frames if how.prune else written(frames, "frames")
        judged = models.judge(options.join(live.select(KEY), KEY, "left_semi"), evidence, KEY).join(options, [KEY, "opt"]).join(limits, KEY)
        score = F.col("rubric_score") if how.judge_by_rubric else F.col("threshold")
        judged = written(judged.withColumn("judgment", verdict.enforced(score, F.col("said"), F.col("threshold"))).drop("threshold"), "judged")
        said = judged.groupBy(KEY).agg(F.max_by("opt", F.struct((F.col("said") == "true").cast("int"), F.col("rubric_score"))).alias("answer"))
        state = verdict.verdicts(judged, KEY, how.margin).join(said, KEY).join(live.select(KEY, "gold"), KEY).withColumn("round", F.lit(i))
        if how.oracle:
            over = overrides.against_gold(judged.select(KEY, "opt", "judgment"), state.select(KEY, "answer", "gold", "label"), KEY, "opt")
            judged = written(judged.drop("judgment").join(over.select(KEY, "opt", "judgment"), [KEY, "opt"]), "overridden")
            state = state.drop("label").join(over.groupBy(KEY).agg(F.first("label").alias("label")), KEY)
        if how.prune:
            flagged = models.distractors(options, evidence, KEY)
            left, frames_left = overrides.pruned(evidence, flagged, KEY, ["ord"], frames)
            evidence, frames = written(left, "pruned"), frames if frames is None else written(frames_left, "frames")
        counts = evidence.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_evidence"))
        images_of = (frames if frames is not None else evidence.limit(0)).groupBy(KEY).agg(F.least(F.count(F.lit(1)), F.lit(how.most_keyframes)).alias("n_keyframes"))
        state = state.join(counts, KEY, "left").join(images_of, KEY, "left").join(strategy, KEY, "left")
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_evidence", "n_keyframes")]
        state = written(state.select(*[c for c in state.columns if c not in ("n_evidence", "n_keyframes", "strategy")], *zero, F.coalesce("strategy", F.lit("broadcast")).alias("strategy")), "state")
        trace = state if trace is None else trace.unionByName(state)
        over = state if i == how.max_rounds - 1 else state.where("label <> 'INSUFFICIENT'")
        answers.append(over.select(KEY, "answer", "label", (F.col("round") + 1).alias("rounds"), "n_evidence", "n_keyframes"))
        used.append(evidence.join(over.select(KEY), KEY, "left_semi").select(KEY, "ord", "chunk_id", "text"))
        shown.append((frames if frames is not None else spark.createDataFrame([], evidence.select(KEY, "ord", "chunk_id", F.lit("").alias("image")).schema)).join(over.select(KEY), KEY, "left_semi").select(KEY, "ord", "chunk_id", "image"))
        live = live.join(over.select(KEY), KEY, "left_anti")
        if i < how.max_rounds - 1:
            queries = models.plan(live, judged) if models.plan else next_queries(live, judged, how)
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    return as_shown(every(answers), samples, every(used), every(shown), how, models), trace


def repeated_question(samples: DataFrame, chunks: DataFrame, embed, how: Loop | None = None) -> tuple[DataFrame, DataFrame]:
    """The loop that asks the same question every round."""
    how = how or Loop()
    return run_loop(samples, chunks, embed, Loop(**{**vars(how), "single_query": True, "ignore_verifier": True, "repeat_queries": True}))
