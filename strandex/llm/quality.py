"""Quality rules as a learned decision list, in DataFrame functions only.

Text statistics are computed once for every document. From the labelled ones, sequential covering grows conjunctions of thresholds: each
step asks Spark for the labels' counts by statistic and bin among the rows not yet covered (at most statistics x bins rows come back,
whatever the corpus holds), takes the threshold with the best information gain, and goes on while the conjunction still covers good
documents. A rule is then pruned to the prefix that does best on held-out rows; if even that is too weak, the statistic it began with is set
aside and the next best is tried. The list becomes one ordered conditional expression: the first rule that holds rejects, otherwise the
document stays. Of more than MAX_LABELLED labelled documents a sample of about so many, by a hash of the id, teaches the rules.

Defined cases: a null text has no words; labels are 0 (reject) or 1 (keep), others and nulls are ignored, of several labels for a document
the highest counts; without labels of both kinds there are no rules and only the base limits reject; repeated rows are judged alike;
columns beyond those used are carried through or ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import NOT_SPACE, SPACE, Scratch, let, table

#: Labelled documents from which rules are learned at most, about: a third of them only to prune. Their ids are broadcast.
MAX_LABELLED = 50_000
#: Base limits.
MIN_WORDS, REPEAT_PERCENT = 50, 50

#: Statistics on which rules may stand.
STATISTICS = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_per_char", "bangs_per_word", "digits_per_char", "distinct_share", "words_per_line")


def statistics(text: Column) -> Column:
    """A struct of the base counts and of the statistics of one text. Every pass over it is linear in its length, but for a sort of its
    windows where some occur twice."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))

    def repeated(w):
        n = F.size(w) - 2
        windows = F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def covered(at):
            return F.aggregate(F.transform(at, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - v, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

        def twice(h):
            s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            same = lambda e, f: F.coalesce(e.h == f.h, F.lit(False))
            at = lambda z: F.sort_array(F.transform(F.filter(z, lambda e, k: same(e, F.get(z, k - 1)) | same(e, F.get(z, k + 1))), lambda e: e.i))
            return let(let(s, at), covered)

        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(twice(h)))

    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    by_line = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    of = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(counts.alias("w"), by_line.alias("l"), of("[#*$%&|<>]").alias("n_symbols"), of("[A-Z]").alias("n_upper"), of("!").alias("n_bangs"), of("[0-9]").alias("n_digits"))


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, the base counts, base_failed and the statistics."""
    s = docs.select(*[F.col(c) for c in keep], statistics(F.col("text")).alias("_s"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    w, x = F.col("_s.w"), F.col("_s")
    n = w.n_words
    return s.select(
        *keep,
        n.alias("n_words"), w.word_chars.alias("word_chars"), x.n_symbols.alias("n_symbols"), F.col("_s.l").n_dup_lines.alias("n_dup_lines"), w.n_repeat_words.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * w.n_repeat_words > REPEAT_PERCENT * n)).alias("base_failed"),
        share(w.word_chars, n).alias("mean_word"), share(x.n_symbols, n).alias("symbols_per_word"), share(F.col("_s.l").n_dup_lines, F.col("_s.l").n_lines).alias("dup_line_share"),
        share(w.n_repeat_words, n).alias("repeat_share"), share(x.n_upper, w.word_chars).alias("upper_per_char"), share(x.n_bangs, n).alias("bangs_per_word"),
        share(x.n_digits, w.word_chars).alias("digits_per_char"), share(w.n_distinct, n).alias("distinct_share"), share(n, F.col("_s.l").n_lines).alias("words_per_line"),
    )


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rejecting rules, each a conjunction."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        """The list as an ordered conditional expression."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(conjunction(rule), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\notherwise: keep"


def conjunction(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn(train: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_rejected: int = 5, min_precision: float = 0.9, bins: int = 24) -> DecisionList:
    """train: STATISTICS, label (0 reject, 1 keep) and held (boolean: counts only for pruning). Thresholds are quantiles of each statistic
    among the rejected and among all; the table is reduced to counts by vector of bins before covering starts."""
    quantiles = [i / bins for i in range(1, bins)]
    probs = F.array(*[F.lit(q) for q in (0.005, 0.01, 0.02, *quantiles, 0.98, 0.99, 0.995)])
    cuts = train.agg(*[F.percentile_approx(F.when(F.col("label") == y, F.col(s)), probs, 2000).alias(f"{s}_{y}") for s in STATISTICS for y in (0, 1)]).first()
    if cuts is None or cuts["mean_word_0"] is None or cuts["mean_word_1"] is None:
        return DecisionList()
    edges = {s: sorted({*cuts[f"{s}_0"], *cuts[f"{s}_1"]}) for s in STATISTICS}
    binned = train.select(*[sum((F.when(F.col(s) > t, 1).otherwise(0) for t in edges[s]), F.lit(0)).cast("int").alias(s) for s in STATISTICS], "label", "held")
    cells = binned.groupBy(*STATISTICS).agg(*[F.sum(F.when((F.col("label") == y) & (F.col("held") == h), 1).otherwise(0)).alias(f"c{y}{int(h)}") for y in (0, 1) for h in (False, True)])
    cells = Scratch(train.sparkSession, "quality").save(cells, "cells")

    def counts(where: Column) -> dict[str, list]:
        """By statistic, for each bin: rejected and kept rows to grow on, rejected and kept rows held out."""
        long = cells.where(where).select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in STATISTICS])).alias("e"), "c00", "c10", "c01", "c11")
        out = {s: [[0] * 4 for _ in range(len(edges[s]) + 1)] for s in STATISTICS}
        for r in long.groupBy("e").agg(*[F.sum(c).alias(c) for c in ("c00", "c10", "c01", "c11")]).collect():
            out[r.e.s][r.e.b] = [r.c00, r.c10, r.c01, r.c11]
        return out

    def in_bins(rule) -> Column:
        out = F.lit(True)
        for c in rule:
            k = edges[c.statistic].index(c.threshold)
            out = out & ((F.col(c.statistic) > k) if c.above else (F.col(c.statistic) <= k))
        return out

    rules, uncovered, weak = [], F.lit(True), set()
    while len(rules) < max_rules and len(weak) < 3:
        rule, track = [], []
        while len(rule) < max_conditions:
            found = counts(uncovered & in_bins(rule))
            total = [sum(b[i] for b in found["mean_word"]) for i in range(4)]
            if total[0] < min_rejected or not total[1]:
                break
            before, best = math.log2(total[0] / (total[0] + total[1])), None
            for s in STATISTICS:
                if not rule and s in weak:
                    continue
                below = [0] * 4
                for k, t in enumerate(edges[s]):
                    below = [x + y for x, y in zip(below, found[s][k], strict=True)]
                    for above, held in ((False, below), (True, [x - y for x, y in zip(total, below, strict=True)])):
                        if held[0] >= min_rejected:
                            gain = held[0] * (math.log2(held[0] / (held[0] + held[1])) - before)
                            if best is None or gain > best[0]:
                                best = (gain, Condition(s, above, t), held)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            track.append(best[2])
        worth = [(h[2] - h[3]) / max(1, h[2] + h[3]) for h in track]
        if not rule:
            break
        cut = max(range(len(rule)), key=lambda i: (round(worth[i], 3), -i)) + 1
        rule, held = rule[:cut], track[cut - 1]
        if held[0] < min_precision * (held[0] + held[1]) or held[2] < min_precision * (held[2] + held[3]):
            weak.add(rule[0].statistic)
            continue
        rules.append(tuple(rule))
        uncovered = uncovered & ~in_bins(rule)
    return DecisionList(rules)


def chosen_labels(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and label of all labelled documents, or of a sample by a hash of the id, of about most documents, if there are more."""
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    n = y.count()
    return y if n <= most else y.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def labelled(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Rows of stats that pass the base limits and have a label; a third, by a hash of the id, is held out for pruning."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return stats.where("not base_failed").join(F.broadcast(chosen_labels(labels, most)), "doc_id").select(*STATISTICS, "label", held.alias("held"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    stats = scratch.save(described(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    rules = learn(labelled(stats, table(spark, sf_dir, "labels")))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & rules.kept()).alias("kept"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that base limits and rules keep, unchanged. Rules are learned from the labelled documents' statistics alone; then one pass
    over all texts decides."""
    scratch, labels = Scratch(spark, "quality"), table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen_labels(labels).select("doc_id")), "doc_id", "left_semi")
    stats = scratch.save(described(known, ["doc_id"]), "statistics")
    rules = learn(labelled(stats, labels))
    scratch.drop(stats)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return described(whole, ["_row"]).where(~F.col("base_failed") & rules.kept()).select("_row.*")


def quality_base_columns(spark, sf_dir: str) -> DataFrame:
    """What op9 says of each document before any rule is learned."""
    return described(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: Of quality_base_columns; the verdict itself is learned.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM s LEFT JOIN covered USING (doc_id)
"""
