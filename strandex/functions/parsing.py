"""Reading of JSON-like model output as Column functions: the strict reading first, then rescue by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(text: Column) -> Column:
    """Without thoughts and code fences."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(t, r"(?is)<think>.*?</think>", ""))
    t = F.when(bare != "", bare).otherwise(t)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^`+|`+$", ""), r"(?i)^json", "")).otherwise(t)


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such part."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def field(text: Column, name: str, kind: str = "string") -> Column:
    """A field of the first JSON object in a text, null where there is none or it is malformed."""
    return F.try_variant_get(F.try_parse_json(braces(body(text))), f"$.{name}", kind)


def repaired(text: Column) -> Column:
    """The text itself, its fenced part or its braces, whichever is JSON first, as a variant."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(F.trim(text)), F.try_parse_json(F.nullif(F.trim(fenced), F.lit(""))), F.try_parse_json(braces(text)))


def answer_letter(text: Column, n_options: Column) -> Column:
    """JSON's answer if it names an option, else the first capital that stands alone and names one."""
    names = F.transform(F.sequence(F.lit(0), n_options - 1), lambda i: F.char(i + 65))
    said = F.upper(F.substring(F.trim(field(text, "answer")), 1, 1))
    alone = F.get(F.filter(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z])\b"), F.lit(1)), lambda c: F.array_contains(names, c)), 0)
    return F.coalesce(F.when(F.array_contains(names, said), said), alone)


def first_letter(text: Column) -> Column:
    """The first of A to D that stands alone."""
    return F.nullif(F.regexp_extract(text, r"\b([A-D])\b", 1), F.lit(""))


def rescued(text: Column) -> Column:
    """struct<answer, sufficient> of a text that may be no JSON."""
    t = body(text)
    by_pattern = F.nullif(F.upper(F.regexp_extract(t, r'(?i)"answer"\s*:\s*"?\(?([A-Z])\b', 1)), F.lit(""))
    phrase = F.nullif(F.upper(F.regexp_extract(t, r"(?i)\b(?:answer|option|choice)\s+(?:is\s+)?\(?([A-Z])\b", 1)), F.lit(""))
    flag = F.lower(F.regexp_extract(t, r'(?i)"?sufficient"?\s*:\s*"?(\w+)', 1))
    sufficient = F.when(flag != "", flag.isin("true", "yes", "sufficient"))
    return F.struct(F.coalesce(field(text, "answer"), by_pattern, phrase).alias("answer"), F.coalesce(field(text, "sufficient", "boolean"), sufficient).alias("sufficient"))


def strings(text: Column, otherwise: Column, most: int = 4) -> Column:
    """The trimmed, non-empty strings of the first JSON array, at most so many; else an array of one."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    kept = F.slice(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != ""), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(otherwise))


def plan(text: Column, question: Column) -> Column:
    """struct<strategy, queries, reasoning>: an unknown strategy is targeted, a targeted plan without queries asks the question."""
    parsed = F.from_json(braces(text), "strategy string, queries array<string>, reasoning string")
    strategy = F.when(F.lower(parsed.strategy) == "broadcast", F.lit("broadcast")).otherwise("targeted")
    queries = F.filter(F.transform(F.coalesce(parsed.queries, F.expr("array()").cast("array<string>")), lambda s: F.trim(s)), lambda q: q != "")
    failed = F.try_parse_json(braces(text)).isNull()
    queries = F.when((strategy == "targeted") & (F.size(queries) == 0), F.array(question)).otherwise(queries)
    return F.struct(strategy.alias("strategy"), queries.alias("queries"), F.when(failed, F.lit("parse_failed")).otherwise(F.coalesce(parsed.reasoning, F.lit(""))).alias("reasoning"))


def criterion_scores(text: Column) -> Column:
    """map<option, map<criterion, double>>: keys to a capital letter, cells that are no number to 0."""
    raw = F.from_json(text, "map<string, map<string, string>>")
    scores = F.transform_values(raw, lambda _, m: F.transform_values(m, lambda __, v: F.coalesce(v.try_cast("double"), F.lit(0.0))))
    return F.map_from_entries(F.transform(F.map_entries(scores), lambda e: F.struct(F.upper(F.substring(F.trim(e.key), 1, 1)), e.value)))


def judgments(text: Column, allowed: tuple[str, ...] = ("true", "false", "unknown")) -> Column:
    """map<option, value> of allowed values only."""
    raw = F.from_json(text, "map<string, string>")
    clean = F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(F.upper(F.substring(F.trim(e.key), 1, 1)), F.lower(F.trim(e.value)))))
    return F.map_filter(clean, lambda k, v: (k != "") & v.isin(*allowed))


def integers(text: Column) -> Column:
    """The first JSON array of integers; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\[[\d,\s-]*\]", 0), F.lit("")), "array<int>")


def joined(values: Column) -> Column:
    """An array's non-blank items as one string."""
    return F.array_join(F.filter(F.transform(values, lambda s: F.trim(s)), lambda s: s != ""), "; ")


def permutation(order: Column, n: Column) -> Column:
    """order without what is out of range or repeated, then what it misses, in order."""
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))
    valid = F.array_distinct(F.filter(order, lambda i: (i >= 0) & (i < n)))
    return F.concat(valid, F.array_except(every, valid))


def summary(text: Column) -> Column:
    """struct<text, timeline, causality>; the sentinel if any of the three is missing."""
    j = F.from_json(F.to_json(repaired(text)), "text string, timeline array<string>, causality array<string>")
    none = F.struct(F.lit("[summary unavailable]").alias("text"), F.expr("cast(array() as array<string>)").alias("timeline"), F.expr("cast(array() as array<string>)").alias("causality"))
    return F.when(j.text.isNotNull() & j.timeline.isNotNull() & j.causality.isNotNull(), F.struct(j.text.alias("text"), j.timeline.alias("timeline"), j.causality.alias("causality"))).otherwise(none)
