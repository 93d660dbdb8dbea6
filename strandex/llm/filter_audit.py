"""What filters do to each other: every order of five filters, from a histogram of failure masks.

Native expressions give each document a mask with a bit for each filter it fails; copies are found by grouping the texts (by their SHA-256, so
that no text is shuffled) for the smallest id. A part's documents then fall into at most 32 cells, and what any order keeps, removes or loses
at any step is a sum over cells: a document goes at the first filter, in that order, of those that it fails. So texts are read once, and the
120 orders cost 32 cells a part, whatever the corpus holds.

A cell is worth the same for all orders that put the same filters before a step, so sums are made by (filter, filters before), 80 a part, and then
named by order. The Shapley count of a filter needs no orders: a document failing k filters is removed by each of them in 120 / k orders.

Defined cases: a null text is empty, which fails A alone (and E if an empty text has a smaller id); a null part is the empty string; a null id is
nobody's copy and nobody's original, and has no label; repeated rows count each, and rows with one id aren't copies of each other; of several
labels for a document the highest counts, nulls and values other than 1 don't; labels without a document count for nothing; further columns are
ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import SPACE, Scratch, let, table

FILTERS = "ABCDE"
ORDERS = 120
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> Column:
    """The bits of the filters that look at one text: A 1, B 2, C 4, D 8. Linear in the text's length."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    bits = let(counts, lambda c: F.when(c.n < 50, 1).otherwise(0) + F.when(100 * c.d < 65 * c.n, 2).otherwise(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return bits + F.when(100 * capitals > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, scratch: Scratch, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every document. One pass over the texts; from there on only ids, digests and parts travel."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = scratch.save(docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    # written, so that the join reads both sides from their own shuffles and adaptive execution can split a text with very many copies
    ids = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = scratch.save(ids.select("digest", "first"), "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = scratch.save(seen.join(first, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask")), "masks")
    scratch.drop(seen, first)
    return out


def histogram(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """At most 32 rows a part: its documents by mask, and the good and the toxic among them."""
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    counted = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    lost = masked.join(known, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    both = counted.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(lost.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps(spark) -> DataFrame:
    """The 600 steps of the 120 orders: order, step, the bit of its filter and the bits before it."""
    rows = [("".join(order), k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(x) for x in order[:k])) for order in permutations(FILTERS) for k in range(5)]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(cells: DataFrame) -> DataFrame:
    """All orders and steps of every part, from its cells (part, mask, n, good, toxic)."""
    places = F.array(*[F.struct(F.lit(1 << f).alias("bit"), F.lit(b).alias("before")) for f in range(5) for b in range(32) if not b >> f & 1])
    c = cells.select("*", F.explode(places).alias("at")).select("*", "at.bit", "at.before")
    fails, earlier = F.expr("mask & bit != 0"), F.expr("mask & before != 0")
    of = lambda where, value: F.sum(F.when(where, value).otherwise(F.lit(0).cast("long")))
    n = F.col("n")
    sums = c.groupBy("part", "bit", "before").agg(
        of(~fails & ~earlier, n).alias("kept"),
        of(fails & ~earlier, n).alias("removed"),
        of(fails & earlier, n).alias("redundant"),
        of(F.expr("mask = bit"), n).alias("unique_fails"),
        of(fails & ~earlier, F.col("good")).alias("good_lost"),
        of(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        of(fails, (n * F.lit(ORDERS) / F.bit_count("mask")).cast("long")).alias("shapley"),
    )
    # 600 rows at any size
    return sums.join(F.broadcast(steps(cells.sparkSession)), ["bit", "before"]).select("part", "filter_order", "step", *COUNTS)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "audit")
    cells = histogram(masks(table(spark, sf_dir, "documents"), scratch), table(spark, sf_dir, "labels"))
    return audit(scratch.save(cells, "cells"))


#: The orders step by step, over documents instead of cells.
SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (SELECT doc_id, part, {
  'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f FROM words),
marked AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, coalesce(l.quality, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM failed LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
walk AS (SELECT part, o, s::INT AS step, f[ascii(o[s]) - 64] AS fails, list_bool_or([f[ascii(o[i]) - 64] FOR i IN range(1, s)]) AS earlier,
  list_sum([f[i]::INT FOR i IN range(1, 6)]) AS k, good, toxic, o[s] AS x FROM marked, orders, range(1, 6) r(s)),
summed AS (SELECT part, o AS filter_order, step, x,
  count(*) FILTER (WHERE NOT fails AND NOT coalesce(earlier, false)) AS kept, count(*) FILTER (WHERE fails AND NOT coalesce(earlier, false)) AS removed,
  count(*) FILTER (WHERE fails AND coalesce(earlier, false)) AS redundant, count(*) FILTER (WHERE fails AND k = 1) AS unique_fails,
  count(*) FILTER (WHERE fails AND NOT coalesce(earlier, false) AND good = 1) AS good_lost, count(*) FILTER (WHERE fails AND NOT coalesce(earlier, false) AND toxic = 1) AS toxic_lost
  FROM walk GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM summed
"""
