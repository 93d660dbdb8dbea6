"""Sufficiency verdicts from scores of options by criteria, and the accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def option_scores(cells: DataFrame, keys: list[str], score: str = "score", weight: str = "weight") -> DataFrame:
    """cells: keys (sample, option), criterion, score, weight -> rubric_score: the weighted mean; a null weight is 1, a negative 0, no weight 0."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1.0)), F.lit(0.0))
    total = F.sum(w)
    return cells.groupBy(*keys).agg(F.when(total > 0, F.sum(w * F.col(score)) / total).otherwise(0.0).alias("rubric_score"))


def enforced(score: Column, said: Column, threshold: float) -> Column:
    """unknown below the threshold or without a score, else what the model said."""
    return F.when(score.isNull() | (score < threshold), "unknown").otherwise(F.coalesce(said, F.lit("unknown")))


def verdicts(options: DataFrame, key: str, margin: float = 0.2) -> DataFrame:
    """options: key, judgment, rubric_score -> label and the counts behind it."""
    is_ = lambda v: F.col("judgment") == v
    agg = options.groupBy(key).agg(
        F.count_if(is_("true")).alias("n_true"), F.count_if(is_("false")).alias("n_false"), F.count_if(is_("unknown")).alias("n_unknown"),
        F.max(F.when(is_("true"), F.col("rubric_score"))).alias("true_score"), F.max(F.when(is_("unknown"), F.coalesce("rubric_score", F.lit(0.0)))).alias("unknown_score"),
        F.max("rubric_score").alias("best_score"),
    )
    full = (F.col("n_true") == 1) & (F.col("n_unknown") == 0)
    answer = (F.col("n_true") == 1) & (F.col("n_unknown") > 0) & (F.round(F.col("true_score") - F.col("unknown_score"), 9) >= margin)
    return agg.withColumn("label", F.when(full, "FULLY_SUFFICIENT").when(answer, "ANSWER_SUFFICIENT").otherwise("INSUFFICIENT"))


def weak_criteria(cells: DataFrame, options: DataFrame, labels: DataFrame, key: str, option: str, below: float = 0.5) -> DataFrame:
    """For insufficient samples the criteria whose mean over unknown options is low: key, criterion, mean_score."""
    open_ = options.where("judgment = 'unknown'").select(key, option).join(labels.where("label = 'INSUFFICIENT'").select(key), key, "left_semi")
    mean = cells.join(open_, [key, option], "left_semi").groupBy(key, "criterion").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    return mean.where(F.col("mean_score") < below)


def summarise(results: DataFrame) -> DataFrame:
    """By pipeline: n, correct, accuracy, mean number of distinct evidence ids (and its ceiling), total and mean seconds."""
    n_ids = F.size(F.array_distinct(F.transform(F.coalesce("evidence_chunk_ids", F.array()), lambda x: x.cast("string"))))
    r = results.select(F.coalesce("pipeline", F.lit("")).alias("pipeline"), F.coalesce("correct", F.lit(False)).cast("int").alias("c"), n_ids.alias("e"), F.coalesce("elapsed", F.lit(0.0)).alias("s"))
    return r.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").cast("bigint").alias("correct"), F.round(F.avg("c"), 6).alias("accuracy"), F.round(F.avg("e"), 6).alias("avg_evidence"),
        F.ceil(F.avg("e")).cast("bigint").alias("ceil_evidence"), F.round(F.sum("s"), 6).alias("total_s"), F.round(F.avg("s"), 6).alias("avg_s"),
    )


def task_accuracy(results: DataFrame, task: str = "question_type") -> DataFrame:
    """By task and overall: n, correct (a given answer that equals the gold), accuracy, answers without a letter (not overall)."""
    good = (F.col("pred_text") != "") & (F.col("pred_text") == F.col("gold"))
    out = results.rollup(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("correct"), F.count_if(F.col("pred_letter").isNull()).alias("no_letter"), F.grouping(task).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "__overall__").otherwise(F.col(task)).alias("task"), "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.when(F.col("_all") == 0, F.col("no_letter")).alias("no_letter"))


def accuracy_pivot(results: DataFrame, row: str, column: str, values: list[str] | None = None) -> DataFrame:
    """Mean correctness by row and column, and Overall; null where there is nothing. Without values, those that the results have (null, which has no
    column, counts in Overall)."""
    if values is None:
        values = sorted(r[0] for r in results.select(column).where(F.col(column).isNotNull()).distinct().collect())
    cells = [F.round(F.avg(F.when(F.col(column) == v, F.col("correct").cast("int"))), 6).alias(v) for v in values]
    return results.groupBy(row).agg(*cells, F.round(F.avg(F.col("correct").cast("int")), 6).alias("Overall"))


def layer_counts(chunks: DataFrame, by: str) -> DataFrame:
    """By video: duration (latest end, else 0), rows by layer 1 to 4, the layers that have rows."""
    n = [F.count_if(F.col("layer") == k).alias(f"l{k}") for k in range(1, 5)]
    out = chunks.groupBy(by).agg(F.coalesce(F.max("end_time"), F.lit(0.0)).alias("duration"), *n)
    return out.withColumn("layers_present", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"l{k}") > 0, F.lit(str(k))) for k in range(1, 5)])), ","))


def mean_pool(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean vector of each group in long form: pos and value; not scaled to unit length."""
    return rows.select(*by, F.posexplode(vector)).groupBy(*by, "pos").agg(F.avg(F.col("col").cast("double")).alias("value"))
