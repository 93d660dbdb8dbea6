"""What models are asked and how their replies are read, as Column functions: planner, verifier and the analysis of what is missing. Wording is free; what is
pinned is which parts there are, in what order, how they are cut and how replies are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandex.functions import parsing, text

#: How a verifier is asked, by variant.
VERIFIER = {
    "strict": "Score each option by each criterion: 1 where the evidence settles it either way, 0.5 in part, 0 not at all. Then judge each option true, false or unknown, and name what is missing.",
    "loose": "Score each option by each criterion, drawing fair conclusions from indirect evidence. Unknown is for options on which the evidence is silent. Then judge each option true, false or unknown.",
    "plain": "Say whether the evidence as a whole is sufficient or insufficient to answer, why, and what is missing.",
    "attributed": "Weigh each piece of evidence for each option, then say whether the whole is sufficient or insufficient, why, and what is missing.",
    "status": "Give each option a status (verified, excluded, unclear, conflicting), number the evidence that misleads, and say whether the whole is sufficient or insufficient.",
}
#: Statuses that the last variant may give (fixed values).
STATUSES = ("verified", "excluded", "unclear", "conflicting")


def rubric_lines(criteria: Column, rule: Column, threshold: Column, long: bool = False) -> Column:
    """A rubric for a prompt, in one of two layouts (fixed formats). criteria: array<struct<name, description, score_1, score_half, score_0, weight>>; a weight shows where it isn't 1. The long
    layout has a line a score."""
    weight = lambda c: F.when(F.coalesce(c.weight, F.lit(1.0)) != 1, F.concat(F.lit(" [weight="), c.weight.cast("string"), F.lit("]"))).otherwise("")
    if long:
        line = lambda c: F.concat(F.lit("  ["), c["name"], F.lit("] "), weight(c), F.lit("  "), c.description, F.lit("\n    1.0 → "), c.score_1, F.lit("\n    0.5 → "), c.score_half, F.lit("\n    0.0 → "), c.score_0)
        head = F.concat(F.lit("### Rubric Criteria  (scoring: "), rule, F.lit(" of scores; sufficient if score ≥ "), threshold.cast("string"), F.lit(")"))
        return F.array_join(F.concat(F.array(head), F.transform(criteria, line)), "\n")
    line = lambda c: F.concat(F.lit("  Criterion ["), c["name"], F.lit("] "), weight(c), F.lit(": "), c.description, F.lit(" (1="), c.score_1, F.lit("; 0.5="), c.score_half, F.lit("; 0="), c.score_0, F.lit(")"))
    tail = F.concat(F.lit("  Scoring: "), rule, F.lit(" of criteria; sufficient if score >= "), threshold.cast("string"))
    return F.array_join(F.concat(F.transform(criteria, line), F.array(tail)), "\n")


def verifier_prompt(question: Column, candidates: Column, evidence: Column, rubric: Column | None = None) -> Column:
    """Question, options, the rubric if there is one, and the numbered evidence, a blank line between."""
    parts = [F.concat(F.lit("Question: "), question), F.concat(F.lit("Options:\n"), text.option_lines(candidates))]
    parts += [] if rubric is None else [F.concat(F.lit("Rubric:\n"), rubric)]
    parts += [F.concat(F.lit("Evidence, in order:\n"), text.numbered(evidence, "(nothing found so far)")), F.lit("Give the verdict as JSON.")]
    return F.concat_ws("\n\n", *parts)


def holistic_verdict(reply: Column) -> Column:
    """struct<label, option_status, missing, reasoning> of a verifier without a rubric: an unknown label is insufficient, statuses that aren't allowed go, and
    what is missing (a text, or JSON as text) counts only then."""
    said = F.lower(F.trim(parsing.field(reply, "label")))
    label = F.when(said.isin("sufficient", "insufficient"), said).otherwise("insufficient")
    status = parsing.judgments(F.coalesce(parsing.field(reply, "option_status"), F.lit("{}")), STATUSES)
    missing = F.coalesce(F.nullif(parsing.field(reply, "missing_evidence_analysis"), F.lit("")), F.nullif(parsing.field(reply, "missing_evidence"), F.lit("")))
    return F.struct(label.alias("label"), status.alias("option_status"), F.when(label == "insufficient", missing).alias("missing"), F.coalesce(parsing.field(reply, "reasoning"), F.lit("")).alias("reasoning"))


def repair_context(weak: Column, unknown: Column, missing: Column, by_rubric: bool = True) -> Column:
    """What a verdict tells the planner; without a rubric only what is missing."""
    shown = F.trim(F.coalesce(missing, F.lit("")))
    gap = F.when(shown != "", F.concat(F.lit("What is missing: "), shown))
    if not by_rubric:
        return F.coalesce(gap, F.lit(""))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(c, ", ")))
    return F.concat_ws("\n", listed("Weak criteria: ", weak), listed("Open options: ", unknown), gap)


def planner_prompt(question: Column, candidates: Column, history: Column, evidence: Column, missing: Column, sample: int = 5, most: int = 200) -> Column:
    """history: array<array<string>>, the queries of each round, none for a broadcast. Of the evidence its times and the beginnings of the first texts."""
    tried = F.transform(history, lambda q: F.when(F.size(q) > 0, F.concat(F.lit("  "), F.array_join(F.transform(q, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " | "))).otherwise("  [spread]"))
    covered = text.covered_ranges(evidence)
    first = F.transform(F.slice(evidence, 1, sample), lambda t, i: F.concat(F.lit("  [E"), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, most)))
    gap = F.coalesce(missing, F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), question), F.concat(F.lit("Options:\n"), text.option_lines(candidates)),
        F.when(F.size(history) > 0, F.concat(F.lit("Asked before:\n"), F.array_join(tried, "\n"))),
        F.when(covered != "", F.concat(F.lit("Times seen: "), covered)),
        F.when(F.size(evidence) > 0, F.concat(F.lit("Evidence so far, in part:\n"), F.array_join(first, "\n"))),
        F.when(gap != "", F.concat(F.lit("Open: "), gap)), F.lit("Give the next plan as JSON."),
    )


def missing_fact_prompt(question: Column, candidates: Column, evidence: Column, gold: Column, said: Column, most: int = 250) -> Column:
    """Asks what the evidence lacks, where the answer said isn't the gold one; both are letters, and an answer that names no option is unknown."""
    named = lambda letter_, none: F.coalesce(F.nullif(text.option_text(F.coalesce(letter_, F.lit("")), candidates), F.lit("")), F.lit(none))
    cut = F.transform(evidence, lambda t, i: F.concat(F.lit("  [E"), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, most)))
    return F.concat(
        F.lit("Question: "), question, F.lit("\nOptions:\n"), text.option_lines(candidates), F.lit("\n\nEvidence:\n"), F.array_join(cut, "\n"), F.lit("\n\nRight: ("), gold, F.lit(") "), named(gold, "?"),
        F.lit("\nSaid: ("), F.coalesce(said, F.lit("?")), F.lit(") "), named(said, "unknown"), F.lit("\n\nWhat does the evidence lack to support the correct answer?"),
    )


def missing_fact(reply: Column, most: int = 200) -> Column:
    """The description in a reply's JSON, else the reply's beginning."""
    found = F.try_variant_get(F.try_parse_json(parsing.braces(reply)), "$.description", "string")
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(F.coalesce(reply, F.lit("")), 1, most))
