"""Formatting of times, options and evidence as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandex.functions.vector import half_even


def whole(x: Column) -> Column:
    """Rounded half to even, as an integer."""
    return half_even(x).cast("bigint")


def hms(seconds: Column) -> Column:
    s = whole(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def minutes(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def srt_seconds(stamp: Column) -> Column:
    """HH:MM:SS,mmm or HH:MM:SS.mmm as seconds."""
    part = lambda i: F.regexp_extract(stamp, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def cut_at_word(text: Column, most: int) -> Column:
    """At most so many characters, back to the last blank, and an ellipsis; unchanged if short enough."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(text)


def letter(i: Column) -> Column:
    return F.char(i + 65)


def option_lines(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("  ("), letter(i), F.lit(") "), c)), "\n")


def option_inline(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("("), letter(i), F.lit(") "), c)), " ")


def without_option_prefix(text: Column) -> Column:
    return F.when((F.length(text) > 2) & (F.substring(text, 2, 1) == "."), F.trim(F.substring(text, 4, 1 << 30))).otherwise(text)


def option_text(letter_: Column, candidates: Column) -> Column:
    """The candidate a letter names; empty if none."""
    at = F.ascii(letter_) - 65
    return F.when(F.length(letter_) > 0, F.coalesce(F.get(candidates, F.when(at >= 0, at)), F.lit(""))).otherwise("")


def chunk_label(video: Column, chunk: Column, start: Column, end: Column) -> Column:
    return F.concat(video, F.lit("#chunk"), F.format_string("%03d", chunk), F.lit("@"), whole(start).cast("string"), F.lit("-"), whole(end).cast("string"), F.lit("s"))


def time_head(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), whole(start).cast("string"), F.lit("s-"), whole(end).cast("string"), F.lit("s]"))


def evidence_text(text: Column, asr: Column, start: Column, end: Column, layers: dict[str, Column] | None = None, with_time: bool = False, with_asr: bool = False, dialogue_first: bool = False) -> Column:
    """One chunk as evidence; layers (label -> array) appends lines of joined items."""
    speech = F.trim(F.coalesce(asr, F.lit("")))
    has = (speech != "") if with_asr else F.lit(False)
    quote = F.concat(F.lit('[DIALOGUE] "'), speech, F.lit('"'))
    said = F.concat(F.lit("Speech: "), asr)
    head = time_head(start, end)
    if layers is not None:
        parts = [head] if with_time else []
        parts += [F.when(has, quote)] if dialogue_first else []
        parts += [text] + [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: "), F.array_join(v, " | "))) for k, v in layers.items()]
        parts += [] if dialogue_first else [F.when(has, said)]
        return F.concat_ws("\n", *parts)
    plain = F.trim(F.concat(head, F.lit(" "), text)) if with_time else text
    plain = F.when(has, F.concat(plain, F.lit("\n"), said)).otherwise(plain)
    if dialogue_first:
        first = F.trim(F.concat(head if with_time else F.lit(""), F.lit(" "), quote, F.lit("\n"), text))
        return F.when(has, first).otherwise(plain)
    return plain


def embed_text(narrative: Column, speech: Column) -> Column:
    return F.when(F.trim(F.coalesce(speech, F.lit(""))) != "", F.concat(narrative, F.lit("\n\n"), speech)).otherwise(narrative)


def numbered(texts: Column, none: str = "(none)") -> Column:
    """[E1] first, [E2] second, a line each."""
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), t)), "\n")).otherwise(none)


def segmented(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("--- Segment "), (i + 1).cast("string"), F.lit(" ---\n"), t)), "\n\n")


def image_label(ts: Column, segment: Column) -> Column:
    return F.concat(F.lit("[Frame at "), whole(ts).cast("string"), F.lit("s"), F.coalesce(F.concat(F.lit(" — Segment "), segment.cast("string")), F.lit("")), F.lit("]"))


def visual_query(question: Column, candidates: Column) -> Column:
    return F.concat(question, F.lit(" "), F.array_join(candidates, " or "))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def frame_name(chunk: Column, frame: Column) -> Column:
    return F.format_string("c%05d_f%02d.jpg", chunk, frame)


def key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def without_thinking(text: Column) -> Column:
    """What follows the last closing tag of a model's thoughts."""
    return F.trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def covered_ranges(texts: Column) -> Column:
    """Distinct [a s-b s] ranges of all texts in order, as m:ss-m:ss, comma-separated."""
    pattern = r"\[(\d+)s[-–](\d+)s\]"
    starts = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))))
    ends = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(2))))
    both = F.array_sort(F.array_distinct(F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")))))
    return F.array_join(F.transform(both, lambda r: F.concat(minutes(r.a), F.lit("-"), minutes(r.b))), ", ")


def transcript(lines: Column, video_has_speech: Column) -> Column:
    """lines: array<struct<start_s, end_s, text>>. Nothing without subtitles, a marker without an overlap, else the lines."""
    shown = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- ["), hms(x.start_s), F.lit(" --> "), hms(x.end_s), F.lit("] "), x.text)), "\n")
    body = F.when(F.size(lines) > 0, shown).otherwise("- No transcript lines overlap this segment.")
    return F.when(video_has_speech, F.concat(F.lit("Transcript lines:\n"), body, F.lit("\n"))).otherwise("")


def window_subtitles(lines: Column, start: Column, end: Column) -> Column:
    tenth = lambda x: F.format_string("%.1f", half_even(x, 1))
    head = F.concat(F.lit("Subtitles in this window [t="), tenth(start), F.lit("s, "), tenth(end), F.lit("s):"))
    rows = F.transform(lines, lambda x: F.concat(F.lit("[t="), tenth(x.start_s), F.lit("s] "), x.text))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(head), rows), "\n")).otherwise("No subtitles in this window.")


def verdict_hint(judgment: Column, scores: Column) -> Column:
    """judgment: map option -> true/false/unknown; scores: map option -> double."""
    line = lambda e: F.concat(F.lit("  ("), e.key, F.lit(") "), e.value, F.coalesce(F.concat(F.lit(" ["), F.format_string("%.2f", half_even(F.try_element_at(scores, e.key), 2)), F.lit("]")), F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(judgment)), line), "\n")


def grounded_queries(question: Column, candidates: Column) -> Column:
    """A query for each option."""
    return F.transform(candidates, lambda c, i: F.concat(question, F.lit(" Evidence for ("), letter(i), F.lit(") "), c))


def endpoint(counter: Column, n: int) -> Column:
    return F.pmod(counter, F.lit(n))
