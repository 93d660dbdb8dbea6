"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in words by source, language and topic; the cells' weights are raked until the weighted word totals meet the target
shares of all three margins; a document is then drawn with the probability that its cell's weight gives it. Counting, the cells' join and
drawing are DataFrame functions over whole tables, and every value of a margin has its own share. Up to MOST_CELLS cells that occur are
raked on the driver; more are raked by the same steps in Spark, as grouped sums over the table of cells, which is written each round.

The tables here have no topic column, so the query's topic is the form of the text (tabular, listed, short or long prose); any
column or expression serves.

Defined cases: a null margin is the value "(none)"; a null or empty text has no words and stands in its cell with weight; targets that no
document meets are left out and the others scaled; where a margin has targets, a value that has none (or 0) gets weight 0, and its documents aren't
drawn; raking that hasn't settled after ROUNDS rounds warns, and says how far off it is; a topic may be any column; repeated rows share an id and so one draw; further columns are carried through by
mix_documents; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm.common import Scratch, table

MARGINS, NONE = ("source", "lang", "topic"), "(none)"
#: Cells that come to the driver at most.
MOST_CELLS = 1 << 16
ROUNDS, TOLERANCE = 200, 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form(text: Column) -> Column:
    """The topic used where a table has none."""
    t = F.coalesce(text, F.lit(""))
    lines = F.regexp_count(t, F.lit(r"\n")) + 1
    return F.when(F.regexp_count(t, F.lit(r" \| ")) >= 8, "tabular").when(F.length(t) < 60 * lines, "listed").when(F.length(t) < 1500, "short").otherwise("long")


def values(margin: str) -> Column:
    return F.coalesce(F.col(margin), F.lit(NONE))


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights w with the margins of tokens * w in the target shares. tokens: one axis a margin. Slices without words keep their weight, others without a
    share get 0."""
    codes = [x.ravel() for x in np.indices(tokens.shape)]
    return rake_cells(codes, tokens.ravel(), targets, rounds, tolerance).reshape(tokens.shape)


def rake_cells(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The same for a list of cells; codes: each cell's place in a margin's targets, one array a margin."""
    total, w = tokens.sum(), np.ones(len(tokens))
    if not total:
        return w
    for _ in range(rounds):
        worst = 0.0
        for code, share in zip(codes, targets, strict=True):
            have = np.bincount(code, tokens * w, minlength=len(share))
            want = np.where(have > 0, share, 0)
            want = want / want.sum() * total if want.sum() else have
            ratio = np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
            worst = max(worst, float(np.abs(ratio - 1).max()))
            w = w * ratio[code]
        if worst < tolerance:
            break
    else:
        unsettled(rounds, worst)
    return w


def unsettled(rounds: int, off: float) -> None:
    warnings.warn(f"raking is off by {off:.3g} after {rounds} rounds: the targets of the margins may contradict each other", stacklevel=2)


def flattened(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to the present ones to a power: below 1, small sources gain."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def on_driver(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]], power: float) -> DataFrame:
    """cells: MARGINS and n -> the same with weight, raked on the driver."""
    rows = sorted(cells.select(*MARGINS, "n").collect())
    tokens, codes, goal = np.array([x.n for x in rows], float), [], []
    for k, m in enumerate(MARGINS):
        names = sorted({x[k] for x in rows})
        place = {v: i for i, v in enumerate(names)}
        code = np.array([place[x[k]] for x in rows], np.int64)
        want = targets.get(m) or flattened(dict(zip(names, np.bincount(code, tokens, minlength=len(names)).tolist(), strict=True)), power)
        codes.append(code)
        goal.append(np.array([want.get(v, 0.0) for v in names]))
    w = rake_cells(codes, tokens, goal, ROUNDS, TOLERANCE)
    return spark.createDataFrame([(*x, y) for x, y in zip(map(tuple, rows), w.tolist(), strict=True)], ", ".join(f"{m} string" for m in MARGINS) + ", n bigint, weight double")


def in_rounds(scratch: Scratch, cells: DataFrame, targets: dict[str, dict[str, float]], power: float) -> DataFrame:
    """The same in Spark, a table written a round. Weights above zero stay so, and what a value is to have is the same in each round."""
    spark, wanted = scratch.spark, {}
    cells, every = cells.select(*MARGINS, "n", F.lit(1.0).alias("weight")), {}
    for m in MARGINS:
        if targets.get(m):  # a value without a target, of those that have words, starts with weight 0 and keeps it
            every[m] = spark.createDataFrame(list(targets[m].items()), f"{m} string, share double").where("share > 0")
            worded = cells.groupBy(m).agg((F.sum("n") > 0).alias("_words")).join(every[m], m, "left").select(m, (F.col("_words") & F.col("share").isNull()).alias("_gone"))
            cells = cells.join(worded, m).withColumn("weight", F.when(F.col("_gone"), 0.0).otherwise(F.col("weight"))).drop("_gone")
    total = float(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    old = scratch.save(cells.select(*MARGINS, "n", "weight", F.lit(0.0).alias("off")), "round")
    for m in MARGINS:
        have = old.groupBy(m).agg(F.sum("n").cast("double").alias("have"), F.sum(F.col("n") * F.col("weight")).alias("live")).where("live > 0")
        share = have.join(every[m], m).select(m, "share") if m in every else have.select(m, F.pow("have", F.lit(power)).alias("share"))
        share = scratch.save(share, "share")
        wanted[m] = share.select(m, (F.col("share") / F.lit(share.agg(F.coalesce(F.sum("share"), F.lit(1.0))).first()[0]) * F.lit(total)).alias("want"))
    for _ in range(ROUNDS):
        now = old.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum(F.col("n") * F.col("weight")).alias("have")).where("have > 0")
            ratio = have.join(wanted[m], m).select(m, (F.col("want") / F.col("have")).alias("ratio"))
            by = F.coalesce("ratio", F.lit(1.0))
            now = now.join(ratio, m, "left").select(*MARGINS, "n", (F.col("weight") * by).alias("weight"), F.greatest("off", F.abs(by - 1)).alias("off"))
        now = scratch.save(now, "round")
        scratch.drop(old)
        old, off = now, now.agg(F.max("off")).first()[0] or 0.0
        if off < TOLERANCE:
            break
    else:
        unsettled(ROUNDS, off)
    return old.drop("off")


def cell_weights(spark: SparkSession, counted: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.9) -> tuple[DataFrame, bool]:
    """counted: MARGINS and n_tokens -> (one row a cell: the margins, weight and inclusion probability; whether there are MOST_CELLS at most)."""
    scratch = Scratch(spark, "weights")
    cells = scratch.save(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "cells")
    few = cells.count() <= MOST_CELLS
    weighed = on_driver(spark, cells, targets or {}, power) if few else in_rounds(scratch, cells, targets or {}, power)
    scratch.drop(cells)
    top = weighed.agg(F.max(F.when(F.col("n") > 0, F.col("weight")))).first()[0] or 1.0
    return weighed.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") / F.lit(float(top))).alias("probability")), few


def draw(key: Column, seed: int = 17) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed only: retried tasks draw the same."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_cells(docs: DataFrame, cells: DataFrame, few: bool, prefix: str = "_cell_") -> DataFrame:
    """docs (with MARGINS as prefix+margin) joined to their cell's weight and probability; few: the cells may be broadcast."""
    cells = cells.select(*[F.col(m).alias(prefix + m) for m in MARGINS], F.col("weight").alias(prefix + "weight"), F.col("probability").alias(prefix + "probability"))
    return docs.join(F.broadcast(cells) if few else cells, [prefix + m for m in MARGINS])


def mix_documents(spark: SparkSession, docs: DataFrame, topic: Column | None = None, key: str = "doc_id", text: str = "text", seed: int = 17, **how) -> DataFrame:
    """The drawn rows of docs, all columns as they were."""
    topic = form(F.col(text)) if topic is None else topic
    counted = docs.select(values("source").alias("source"), values("lang").alias("lang"), F.coalesce(topic, F.lit(NONE)).alias("topic"), n_words(F.col(text)).alias("n_tokens"))
    sums = Scratch(spark, "mixing").save(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    cells, few = cell_weights(spark, sums, **how)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), values("source").alias("_cell_source"), values("lang").alias("_cell_lang"), F.coalesce(topic, F.lit(NONE)).alias("_cell_topic"))
    return with_cells(marked, cells, few).where(draw(F.col("_key"), seed) < F.col("_cell_probability")).select("_row.*")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "mixing")
    counted = scratch.save(docs.select("doc_id", values("source").alias("source"), values("lang").alias("lang"), form(F.col("text")).alias("topic"), n_words(F.col("text")).alias("n_tokens")), "counted")
    cells, few = cell_weights(spark, counted)
    marked = counted.select("doc_id", "n_tokens", *[F.col(m).alias(f"_cell_{m}") for m in MARGINS])
    drawn = with_cells(marked, cells, few).where(draw(F.col("doc_id")) < F.col("_cell_probability"))
    return drawn.select("doc_id", *[F.col(f"_cell_{m}").alias(m) for m in MARGINS], "n_tokens", F.round("_cell_weight", 9).alias("weight"), F.round("_cell_probability", 9).alias("probability"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(spark, docs)
