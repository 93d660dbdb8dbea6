"""Models behind the plans. A provider turns columns into columns or tables into tables; the plans don't know what stands behind it.

HashEmbedder and the lexical judge are deterministic stand-ins without weights. ModelEmbedder, ModelScorer and Chat carry
any Python model: batches arrive by Arrow, the model is loaded once a worker process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions.vector import tokens
from strandex.scratch import released


class HashEmbedder:
    """Counts of a text's tokens by hash, scaled to unit length. Tokens run between white space, lower-case, each occurrence once. Like a model it sees
    batches of texts; it remembers the places of up to MOST tokens, and gives its memory back when a task ends."""

    MOST = 1 << 16

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        dim, most = self.dim, self.MOST

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            places = {}

            def place(token):
                if len(places) >= most:
                    places.clear()
                places[token] = at = int.from_bytes(hashlib.md5(token).digest()[:4]) % dim
                return at

            def vector(text):
                if text is None:
                    return None
                tokens = text.encode().split()  # of bytes: at ASCII white space
                at = [places[t] if t in places else place(t) for t in tokens]
                counts = np.bincount(np.array(at, np.int64), minlength=dim).astype(float)
                return counts / (np.sqrt(counts @ counts) + 1e-12)

            def vectors(parts):
                for texts in parts:
                    yield pd.Series([vector(t) for t in texts], dtype=object)

            return released(vectors)(parts)

        return run(F.lower(text))


class ModelEmbedder:
    """load() -> f(list of texts or images) -> matrix; rows are scaled to unit length."""

    def __init__(self, load: Callable[[], Callable], batch: int = 16):
        self.load, self.batch = load, batch

    def __call__(self, column: Column) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                out = [model(list(s.iloc[i : i + batch])) for i in range(0, len(s), batch)]
                m = np.concatenate(out) if out else np.zeros((0, 0))
                yield pd.Series(list(m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)), dtype=object)

        return run(column)


class ModelScorer:
    """load() -> f(list of (query, passage)) -> scores; for a cross-encoder."""

    def __init__(self, load: Callable[[], Callable]):
        self.load = load

    def __call__(self, query: Column, passage: Column) -> Column:
        load = self.load

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, p in parts:
                yield pd.Series(model(list(zip(q, p, strict=True))), dtype=float)

        return run(query, passage)


class Chat:
    """load() -> f(list of prompts) -> list of answers; adds column `answer`. Failed calls are tried again, doubling the wait."""

    def __init__(self, load: Callable[[], Callable], retries: int = 3, base_s: float = 2.0):
        self.load, self.retries, self.base_s = load, retries, base_s

    def __call__(self, rows: DataFrame, prompt: str = "prompt") -> DataFrame:
        load, retries, base = self.load, self.retries, self.base_s

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            model = load()
            for p in parts:
                for n in range(retries):
                    try:
                        said = model(list(p[prompt]))
                        break
                    except Exception:
                        if n == retries - 1:
                            raise
                        time.sleep(min(base * 2**n, 60))
                yield p.assign(answer=said)

        return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string")


def lexical_judge(options: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """options: key, opt, candidate; evidence: key, text -> key, opt, rubric_score (share of an option's tokens that its evidence has), said: true
    for the best option (the first of equals), false for the others."""
    from strandex.operators.sequence import Window

    pool = evidence.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))))).alias("_pool"))
    t = tokens(F.col("candidate"))
    score = F.when(F.size(t) > 0, F.size(F.array_intersect(t, F.coalesce("_pool", F.expr("array()").cast("array<string>")))) / F.size(t)).otherwise(0.0)
    s = options.join(pool, key, "left").select(key, "opt", F.round(score, 9).alias("rubric_score"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rubric_score"), "opt")) == 1
    return s.withColumn("said", F.when(best, "true").otherwise("false"))


def lexical_distractors(options: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, place of evidence (from 1, by ord) that has no token of any option."""
    from strandex.operators.sequence import Window

    asked = options.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("candidate"))))).alias("_asked"))
    placed = evidence.select(key, "text", F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("place"))
    return placed.join(asked, key).where(~F.arrays_overlap(tokens(F.col("text")), "_asked")).select(key, "place")


def lexical_order(samples: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """evidence with place: by the number of the question's tokens that it has, of equals as found."""
    from strandex.operators.sequence import Window

    both = evidence.join(samples.select(key, tokens(F.col("question")).alias("_q")), key)
    shared = F.size(F.array_intersect(tokens(F.col("text")), F.col("_q")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(shared), "ord"))).drop("_q")


def lexical_asks(answers: DataFrame, samples: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, ids (the evidence's chunks) and said: a reply that lists the chunks with less than half of the answer's tokens, whose frames have to be seen."""
    place = F.ascii("answer") - 65
    chosen = answers.join(samples.select(key, "candidates"), key).select(key, tokens(F.coalesce(F.get("candidates", F.when(place >= 0, place)), F.lit(""))).alias("_a"))
    rows = evidence.join(chosen, key).withColumn("_few", 2 * F.size(F.array_intersect(tokens(F.col("text")), F.col("_a"))) < F.size("_a"))
    listed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("_few"), F.col("chunk_id").cast("string")))), ", ")
    return rows.groupBy(key).agg(F.collect_set("chunk_id").alias("ids"), F.concat(F.lit("I need ["), listed, F.lit("].")).alias("said"))
