"""Chat formatting for preference training.

Pairs of conversations, chosen and rejected, are compared turn by turn: the longest common prefix of turns is rendered once as the prompt,
the two remainders are rendered as completions, and each completion carries the character spans on which the loss counts (the texts of its
assistant turns). Everything is DataFrame functions; one shuffle brings a pair's turns together, and a pair is one training record, so its
size is that of two conversations.

Defined cases: a null text is the empty text, a null role is "unknown"; turns stand in the order (turn, role, text), nulls first, and a
repeated row is a repeated turn; rows whose pair id is null belong to no pair and are left out; a pair without a side has an empty one;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import let, table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def render(turns: Column) -> Column:
    """The chat template: <|role|>, a line break, the text, <|end|>, a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(CLOSE), t.text, F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) of each assistant text in render(turns), in code points."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc, t):
        head = acc.at + len(OPEN) + F.length(t.role) + len(CLOSE)
        end = (head + F.length(t.text)).cast("long")
        span = F.array(F.struct(head.cast("long").alias("start"), end.alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(t.role == "assistant", F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc.spans)


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns have the same role and text."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get(a, i).role != F.get(b, i).role) | (F.get(a, i).text != F.get(b, i).text))
    return F.array_min(differs)


def format_pairs(pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs: an id and two arrays of struct<role,text> -> pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""

    def record(a, b):
        n = common_turns(a, b)

        def rest(x, k):
            return F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))

        return let(n, lambda k: F.struct(k.cast("long").alias("n_common"), render(F.slice(a, 1, k)).alias("prompt"), render(rest(a, k)).alias("chosen"), render(rest(b, k)).alias("rejected"), loss_spans(rest(a, k)).alias("chosen_spans"), loss_spans(rest(b, k)).alias("rejected_spans")))

    return pairs.select(F.col(pair_id).alias("pair_id"), record(F.col(chosen), F.col(rejected)).alias("r")).select("pair_id", "r.*")


def turn_struct() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


#: Where the rejected side of a pair leaves the chosen one: at once, before the first answer, half way, before the last answer, never.
PLACES = 5


def leaves_after(turns: Column, place: Column) -> Column:
    """How many turns the rejected side keeps; without an answer to leave before, all."""
    n = F.size(turns)
    answers = F.transform(turns, lambda t: t.role == "assistant")
    first = F.array_position(answers, True)
    last = F.array_position(F.reverse(answers), True)
    before = lambda at: F.when(at > 0, at - 1).otherwise(n)
    return F.when(place == 0, 0).when(place == 1, before(first)).when(place == 2, F.floor(n / 2)).when(place == 3, before(F.when(last > 0, n - last + 1).otherwise(0))).otherwise(n).cast("int")


def regenerated_pairs(conversations: DataFrame) -> DataFrame:
    """A preference pair for every conversation: chosen is the conversation, rejected begins like it and then goes on as its neighbour does from
    the same place on (ids 2k and 2k + 1 are neighbours; where one is absent, rejected just ends there). Where it leaves depends on the id."""
    conv = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn_struct().alias("t"))
    blocks = conv.groupBy(F.shiftright("conv_id", 1).alias("block")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "t"))).alias("rows"))

    def side(parity: int) -> Column:
        own = F.filter(F.col("rows"), lambda r: F.pmod(r.conv_id, F.lit(2)) == parity)
        return F.transform(own, lambda r: F.struct(r.t.role.alias("role"), r.t.text.alias("text")))

    both = blocks.select("block", side(0).alias("a"), side(1).alias("b"))
    place = F.pmod("block", F.lit(PLACES))

    def pair(k: int, x: Column, y: Column) -> Column:
        rejected = let(leaves_after(x, place), lambda n: F.concat(F.slice(x, 1, n), F.slice(y, n + 1, F.greatest(F.size(y) - n, F.lit(0)))))
        return F.struct((F.shiftleft("block", 1) + k).alias("pair_id"), x.alias("chosen"), rejected.alias("rejected"))

    pairs = both.select(F.explode(F.array(pair(0, F.col("a"), F.col("b")), pair(1, F.col("b"), F.col("a")))).alias("p")).select("p.*")
    return pairs.where(F.size("chosen") > 0)


def op1_preference_format(spark, sf_dir: str) -> DataFrame:
    out = format_pairs(regenerated_pairs(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ",")
    return out.withColumns({c: text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (
  SELECT conv_id, count(*) AS n, coalesce(min(n) FILTER (role = 'assistant') - 1, count(*)) AS first, coalesce(max(n) FILTER (role = 'assistant') - 1, count(*)) AS last
  FROM t GROUP BY conv_id),
leave AS (SELECT conv_id, CASE (conv_id >> 1) % 5 WHEN 0 THEN 0 WHEN 1 THEN first WHEN 2 THEN n // 2 WHEN 3 THEN last ELSE n END AS after FROM size),
rejected AS (
  SELECT l.conv_id, t.n, t.role, t.text FROM leave l JOIN t ON t.conv_id = l.conv_id AND t.n <= l.after
  UNION ALL SELECT l.conv_id, t.n, t.role, t.text FROM leave l JOIN t ON t.conv_id = xor(l.conv_id, 1) AND t.n > l.after),
met AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.n, r.n) AS n, coalesce(c.role = r.role AND c.text = r.text, FALSE) AS same
  FROM t c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.n = r.n),
common AS (SELECT conv_id, coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS k FROM met GROUP BY conv_id),
sides AS (SELECT 'c' AS side, conv_id, n, role, text FROM t UNION ALL SELECT 'r', conv_id, n, role, text FROM rejected),
drawn AS (
  SELECT s.conv_id, s.side, s.n, s.role, length(s.role) AS w, length(s.text) AS x, s.n > k AS own, '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS d
  FROM sides s JOIN common USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(d)) FILTER (own) OVER (PARTITION BY conv_id, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 + w + 3 AS spot FROM drawn),
texts AS (
  SELECT conv_id, string_agg(d, '' ORDER BY n) FILTER (side = 'c' AND NOT own) AS prompt, string_agg(d, '' ORDER BY n) FILTER (side = 'c' AND own) AS chosen, string_agg(d, '' ORDER BY n) FILTER (side = 'r' AND own) AS rejected,
         string_agg(spot::BIGINT || '-' || (spot + x)::BIGINT, ',' ORDER BY n) FILTER (side = 'c' AND own AND role = 'assistant') AS chosen_spans,
         string_agg(spot::BIGINT || '-' || (spot + x)::BIGINT, ',' ORDER BY n) FILTER (side = 'r' AND own AND role = 'assistant') AS rejected_spans
  FROM placed GROUP BY conv_id)
SELECT conv_id AS pair_id, CAST(k AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans
FROM common JOIN texts USING (conv_id)
"""
