"""Joins: intervals by time bins, resume and filter joins, keyword routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(cues: DataFrame, windows: DataFrame, by: str, bin_s: float, closed: bool = True, cue: tuple[str, str] = ("start_s", "end_s"), window: tuple[str, str] = ("t_start", "t_end")) -> DataFrame:
    """Pairs of a cue and a window that overlap; closed: touching ends count. Both sides are cut into bins of time, so the join is by equal
    (key, bin); a pair is kept in the bin of the later start only, so it comes once."""
    def bins(a, b):
        return F.explode(F.sequence(F.floor(F.col(a) / bin_s), F.floor(F.greatest(F.col(a), F.col(b)) / bin_s)))

    c = cues.withColumn("_bin", bins(*cue))
    w = windows.withColumn("_bin", bins(*window)).withColumnRenamed(by, "_by")
    cs, ce, ws, we = (F.col(x) for x in (*cue, *window))
    hit = (ce >= ws) & (cs <= we) if closed else (ce > ws) & (cs < we)
    once = F.col("c._bin") == F.floor(F.greatest(cs, ws) / bin_s)
    return c.alias("c").join(w.alias("w"), (F.col(by) == F.col("_by")) & (F.col("c._bin") == F.col("w._bin")) & hit & once).drop("_by", "_bin")


def speech_of(pairs: DataFrame, keys: list[str], order: list[str], text: str) -> Column | DataFrame:
    """The cues' texts of each window in order, joined by blanks."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"]), " ")
    return pairs.groupBy(*keys).agg(said.alias("speech"))


def not_done(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose key has no result yet; error results count as done unless the caller leaves them out of done."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def with_bank(samples: DataFrame, banks: DataFrame, key: str) -> DataFrame:
    """Every sample with its bank's columns, and error 'bank_missing' where there is none."""
    return samples.join(banks.withColumn("_has", F.lit(True)), key, "left").withColumn("error", F.when(F.col("_has").isNull(), "bank_missing")).drop("_has")


def route(question: Column, rules: list[tuple[list[str], str]], fallback: Column | None = None) -> Column:
    """The type of the first rule one of whose keywords a question contains, else the fallback."""
    low = F.lower(question)
    out = F.lit(None).cast("string") if fallback is None else fallback
    for words, kind in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.instr(low, w) > 0)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out
