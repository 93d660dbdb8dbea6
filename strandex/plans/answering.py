"""Registered queries about answers: rubrics, plans and their filters, evidence and keyframes on their way to an answer, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.functions import parsing, text, vector
from strandex.operators import answers, dedup, sequence, verdict
from strandex.operators.sequence import Window
from strandex.plans.catalog import CELLS, CHUNKS, GREEDY, chunks, judged, query, seconds
from strandex.plans.rubric import Rubric
from strandex.session import table

#: A rubric over words and languages that the test documents have.
RUBRIC = Rubric.of({
    "general": {"rubric_criteria": [{"name": "coverage"}, {"name": "consistency"}], "scoring_rule": "average", "sufficient_threshold": 0.75},
    "templates": {"causal": {"rubric_criteria": [{"name": "cause"}], "sufficient_threshold": 0.8}, "temporal": {"rubric_criteria": [{"name": "order"}, {"name": "span"}], "scoring_rule": "minimum"}, "visual": {"rubric_criteria": []}},
    "type_aliases": {"de": "visual", "fr": "temporal", "es": "nowhere"},
    "keyword_rules": [{"keywords": ["nowhere"], "qtype": "absent"}, {"keywords": ["thing", "these"], "qtype": "causal"}, {"keywords": "then", "qtype": "temporal"}],
})


@query("""WITH k AS (SELECT doc_id, CASE WHEN lower(coalesce(text, '')) LIKE '%thing%' OR lower(coalesce(text, '')) LIKE '%these%' THEN 'causal' WHEN lower(coalesce(text, '')) LIKE '%then%' THEN 'temporal' WHEN lang = 'de' THEN 'visual' WHEN lang = 'fr' THEN 'temporal' ELSE '' END AS template FROM documents)
SELECT doc_id, template, CASE template WHEN 'causal' THEN 'coverage,consistency,cause' WHEN 'temporal' THEN 'coverage,consistency,order,span' ELSE 'coverage,consistency' END AS criteria,
CASE WHEN template = 'temporal' THEN 'minimum' ELSE 'average' END AS scoring_rule, CASE WHEN template = 'causal' THEN 0.8 ELSE 0.75 END::DOUBLE AS threshold FROM k""")
def rubric_route(spark, d):
    rows = RUBRIC.applied(table(spark, d, "documents").select("doc_id", "text", "lang"), "text", "lang")
    return rows.select("doc_id", "template", F.array_join("criteria", ",").alias("criteria"), "scoring_rule", "threshold")


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS k FROM documents),
q AS (SELECT video_id, chunk_id, v, k FROM c JOIN t ON doc_id = chunk_id WHERE chunk_id % 20 = 0), h AS (SELECT video_id, k FROM c JOIN t ON doc_id = chunk_id WHERE chunk_id % 20 = 1), e AS (SELECT video_id, v FROM c WHERE chunk_id % 20 = 2),
nq AS (SELECT q.chunk_id, round(max(CASE WHEN len(q.k) = 0 OR len(h.k) = 0 THEN 0.0 ELSE len(list_intersect(q.k, h.k)) / len(list_distinct(list_concat(q.k, h.k))) END), 6) AS x FROM q JOIN h USING (video_id) GROUP BY 1),
ne AS (SELECT q.chunk_id, max(round(list_dot_product(q.v, e.v), 6)) AS x FROM q JOIN e USING (video_id) GROUP BY 1),
r AS (SELECT q.video_id, q.chunk_id AS q_pos, nq.x AS nearest_query, ne.x AS nearest_evidence, coalesce(nq.x < 0.05, TRUE) AND coalesce(ne.x < 0.15, TRUE) AS kept FROM q LEFT JOIN nq USING (chunk_id) LEFT JOIN ne USING (chunk_id))
SELECT *, CASE WHEN bool_or(kept) OVER (PARTITION BY video_id) THEN 'targeted' ELSE 'broadcast' END AS strategy FROM r""")
def filtered_plan(spark, d):
    """Queries that repeat earlier ones or drift to what was found go; where all go, the plan is a broadcast."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), vector.tokens(F.col("text")).alias("tokens"))
    c = chunks(spark, d)
    asked = c.where("chunk_id % 20 = 0").join(words, "chunk_id").select("video_id", F.col("chunk_id").alias("q_pos"), "tokens", F.col("v_dynamic").alias("q_vec"))
    before = c.where("chunk_id % 20 = 1").join(words, "chunk_id").select("video_id", "tokens")
    found = c.where("chunk_id % 20 = 2").select("video_id", F.col("v_dynamic").alias("v"))
    return answers.targeted_or_broadcast(asked, before, found, "video_id", 0.05, 0.15)


@query("""WITH s AS (SELECT doc_id, CAST(n_chars % 7 AS INT) AS n, CASE WHEN doc_id % 4 = 0 THEN [] ELSE list_filter([CAST(doc_id % 5 AS INT), 9, CAST(doc_id % 3 AS INT), 1], lambda i: i < n_chars % 7)[1:3] END AS v FROM documents),
p AS (SELECT doc_id, CASE WHEN len(v) > 0 THEN list_transform(v, lambda x, i: {'idx': x, 'score': round(1 - (i - 1) * 0.01, 2)}) ELSE list_transform(range(least(n, 3)), lambda x: {'idx': x::INT, 'score': 1.0::DOUBLE}) END AS p FROM s)
SELECT doc_id, CAST(unnest(range(len(p))) AS INT) AS rank, unnest(list_transform(p, lambda x: x.idx)) AS idx, unnest(list_transform(p, lambda x: x.score)) AS score FROM p""")
def listwise_select(spark, d):
    listed = F.concat_ws(", ", *[x.cast("string") for x in (F.col("doc_id") % 5, F.lit(9), F.col("doc_id") % 3, F.lit(1))])
    said = F.when(F.col("doc_id") % 4 == 0, "none of them").otherwise(F.concat(F.lit('so {"selected": ['), listed, F.lit("]} it is")))
    picked = table(spark, d, "documents").select("doc_id", answers.selected(said, (F.col("n_chars") % 7).cast("int"), 3).alias("p"))
    return picked.select("doc_id", F.posexplode("p").alias("rank", "p")).select("doc_id", "rank", "p.idx", "p.score")


@query(f"SELECT video_id, chunk_id, r AS rank FROM (SELECT video_id, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS r FROM ({GREEDY % 'TRUE'})) WHERE r <= 5")
def visual_dedup(spark, d):
    """Images whose chunk is near to a kept one go, then the cap counts."""
    kept = dedup.greedy_similarity(chunks(spark, d), "video_id", "chunk_id", "v_dynamic", 0.2)
    return sequence.first_per_key(kept, ["video_id"], ["chunk_id"], 5).withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("chunk_id")).cast("bigint"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, event_id, value FROM events), s AS (SELECT *, value IS NOT NULL AND row_number() OVER (PARTITION BY user_id, h ORDER BY value DESC NULLS LAST, event_id) = 1 AS sharpest FROM e)
SELECT user_id, h, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY sharpest DESC, event_id) AS r FROM s) WHERE r <= 3""")
def chunk_frames(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(seconds() / 3600).cast("bigint").alias("h"), "event_id", "value")
    best = F.row_number().over(Window.partitionBy("user_id", "h").orderBy(F.desc_nulls_last("value"), "event_id")) == 1
    rows = answers.frames_of(e.withColumn("sharpest", F.col("value").isNotNull() & best), ["user_id", "h"], "event_id", "sharpest", 3)
    order = Window.partitionBy("user_id", "h").orderBy(F.desc("sharpest"), "event_id")
    return rows.select("user_id", "h", "event_id", F.row_number().over(order).cast("bigint").alias("rank"))


@query(f"""WITH {CELLS}, a AS (SELECT l_orderkey, arg_max(opt, (rubric_score, -opt)) AS answer FROM opts GROUP BY 1), g AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 + 1 END AS gold FROM orders)
SELECT l_orderkey, opt, CASE WHEN gold IS NOT NULL AND answer <> gold THEN CASE WHEN opt = gold THEN 'unknown' ELSE 'false' END ELSE judgment END AS judgment,
CASE WHEN answer = gold THEN 'FULLY_SUFFICIENT' WHEN gold IS NOT NULL THEN 'INSUFFICIENT' ELSE label END AS label, coalesce(answer = gold, FALSE) AS frozen
FROM opts JOIN a USING (l_orderkey) JOIN g USING (l_orderkey) JOIN lab USING (l_orderkey)""")
def oracle_override(spark, d):
    options = judged(spark, d)
    best = options.groupBy("l_orderkey").agg(F.max_by("opt", F.struct("rubric_score", -F.col("opt"))).alias("answer"))
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 3 + 1).alias("gold"))
    labels = verdict.verdicts(options, "l_orderkey").select("l_orderkey", "label")
    out = answers.against_gold(options.select("l_orderkey", "opt", "judgment"), best.join(gold, "l_orderkey").join(labels, "l_orderkey"), "l_orderkey", "opt")
    return out.withColumn("frozen", F.coalesce("frozen", F.lit(False)))


TURNS = "t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations)"


@query(f"WITH {TURNS} SELECT conv_id, turn, place, text, turn % 2 = 0 AS has_keyframe FROM t WHERE place <> 2 AND place <> conv_id % 4 + 1")
def pruned_evidence(spark, d):
    """Flagged places go from the evidence, and with them their keyframes; places that aren't there are ignored."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    e = table(spark, d, "conversations").withColumn("place", place).withColumn("chunk_id", F.col("place"))
    flagged = e.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(2).cast("bigint"), F.col("conv_id") % 4 + 1, F.lit(99).cast("bigint"))).alias("place"))
    frames = e.where("turn % 2 = 0").select("conv_id", "chunk_id")
    left, frames = answers.pruned(e, flagged, "conv_id", ["place"], frames)
    shown = left.join(frames.withColumn("_f", F.lit(True)), ["conv_id", "chunk_id"], "left")
    return shown.select("conv_id", "turn", "place", "text", F.coalesce("_f", F.lit(False)).alias("has_keyframe"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), g AS (SELECT user_id, list(event_id) FILTER (r <= 4) AS ids FROM e GROUP BY 1)
SELECT user_id, event_id AS chunk_id, CASE WHEN user_id % 3 = 0 THEN 'fail' ELSE 'ok' END AS status FROM e JOIN g USING (user_id) WHERE user_id % 3 = 0 OR (list_contains(ids, event_id) AND r <= user_id % 6)""")
def text_first_gate(spark, d):
    """A reply names the chunks whose frames are needed: ids that are no evidence don't count, and a reply without a list keeps all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("chunk_id"), F.row_number().over(w).alias("r"))
    few = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.struct("r", "chunk_id")))), lambda s: s.chunk_id.cast("string")), ", ")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 4, F.struct("r", "chunk_id")))), lambda s: s.chunk_id)
    said = F.when(F.col("user_id") % 3 == 0, "all of them").otherwise(F.concat(F.lit("I need ["), F.col("listed"), F.lit("].")))
    replies = e.groupBy("user_id").agg(ids.alias("ids"), few(F.col("user_id") % 6).alias("listed")).select("user_id", "ids", said.alias("said"))
    return answers.gated(e.select("user_id", "chunk_id"), replies, "user_id").select("user_id", "chunk_id", "status")


@query("""WITH e AS (SELECT user_id, event_id AS chunk_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events), k AS (SELECT user_id, event_id AS chunk_id FROM events),
r AS (SELECT user_id, chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY p.place NULLS LAST, chunk_id) AS rank FROM k LEFT JOIN (SELECT * FROM e WHERE place <= 3) p USING (user_id, chunk_id)) SELECT * FROM r WHERE rank <= 8""")
def keyframes_along_evidence(spark, d):
    """Keyframes in the order of reranked evidence, orphans last, capped."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("chunk_id"), place.alias("place"))
    frames = table(spark, d, "events").select("user_id", F.col("event_id").alias("chunk_id"))
    return answers.along_evidence(frames, e.where("place <= 3"), "user_id", ["chunk_id"], 8)


@query("""WITH r AS (SELECT doc_id, source, lang, text, coalesce(l.quality, -1) AS q, [lang, source, 'none'] AS c FROM documents LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'b) it' WHEN doc_id % 3 = 1 THEN 'e' ELSE '' END AS answer, CASE WHEN doc_id % 2 = 0 THEN 'I say C.' ELSE 'no' END AS raw FROM r),
p AS (SELECT *, CASE WHEN answer IS NULL THEN '' WHEN answer <> '' THEN upper(answer[1]) WHEN doc_id % 2 = 0 THEN 'C' ELSE '' END AS letter FROM s),
t AS (SELECT *, CASE WHEN letter IN ('A', 'B', 'C') THEN c[ascii(letter) - 64] ELSE '' END AS pred_text, CASE WHEN q = 1 THEN source WHEN q = 0 THEN '' ELSE 'none' END AS gold FROM p)
SELECT 'docs|' || source || '|' || doc_id || '|loop' AS key, letter AS pred_letter, pred_text, answer IS NOT NULL AND pred_text = gold AS correct, CAST(len(list_distinct([doc_id % 7, doc_id % 5])) AS INT) AS n_ids,
round_even(length(text) / 777.0, 2) AS elapsed, CASE WHEN answer IS NULL THEN 'stopped' END AS error FROM t""")
def result_record(spark, d):
    """Correct without a guard against empty answers: an empty gold is met by an empty prediction."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    failed = F.col("doc_id") % 11 == 0
    gold = F.when(F.col("quality") == 1, F.col("source")).when(F.col("quality") == 0, "").otherwise("none")
    runs = rows.select(
        F.lit("docs").alias("benchmark"), F.col("lang").alias("question_type"), F.col("source").alias("video_id"), F.col("doc_id").alias("sample_idx"), F.col("text").alias("question"), F.array("lang", "source", F.lit("none")).alias("candidates"), gold.alias("gold_answer"),
        F.when(~failed, F.when(F.col("doc_id") % 3 == 0, "b) it").when(F.col("doc_id") % 3 == 1, "e").otherwise("")).alias("answer"), F.when(F.col("doc_id") % 2 == 0, "I say C.").otherwise("no").alias("raw"),
        F.array_distinct(F.array((F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 5).cast("string"))).alias("evidence_chunk_ids"), F.lit(0).cast("bigint").alias("n_keyframes_to_answer"), F.lit(2).cast("bigint").alias("n_evidence_to_answer"), F.lit(1).cast("bigint").alias("trace_iters"),
        (F.length("text") / 777.0).cast("double").alias("elapsed"), F.when(failed, "stopped").alias("error"),
    )
    return answers.records(runs, "loop").select("key", "pred_letter", "pred_text", "correct", F.size("evidence_chunk_ids").alias("n_ids"), "elapsed", "error")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000")
def half_open_range(spark, d):
    return answers.in_range(table(spark, d, "orders"), "o_orderkey", 100, 2000).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS padded, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def id_map_lookup(spark, d):
    """Numeric ids, padded with zeros, looked up in a map of ids. The map is a table of its own, so its size decides how the join is run."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 3, "0").alias("padded")
    return table(spark, d, "supplier").select("s_suppkey", pad("s_nationkey")).join(table(spark, d, "nation").select(pad("n_nationkey"), "n_name"), "padded", "left").select("s_suppkey", "padded", "n_name")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS s FROM events), d AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS duration FROM e)
SELECT user_id, CAST(floor(s / 600) AS BIGINT) AS idx, CAST(floor(s / 600) * 600 AS DOUBLE) AS t_start, round(least((floor(s / 600) + 1) * 600, any_value(duration)), 3) AS t_end, count(*) AS n FROM d
WHERE floor(s / 600) < greatest(1, ceil(duration / 600)) GROUP BY user_id, floor(s / 600)""")
def clipped_windows(spark, d):
    """Tumbling windows from a sequence's start, the last one cut at its duration; windows without a frame don't exist."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", ((us - F.min(us).over(own)) / 1_000_000).alias("s"))
    e = e.withColumn("duration", F.max("s").over(own)).where(F.floor(F.col("s") / 600) < F.greatest(F.lit(1), F.ceil(F.col("duration") / 600)))
    out = sequence.tumbling(e, ["user_id"], F.col("s"), 600, F.max("duration").alias("duration"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "idx", (F.col("idx") * 600).cast("double").alias("t_start"), F.round(F.least((F.col("idx") + 1) * 600, F.col("duration")), 3).cast("double").alias("t_end"), "n")


@query(f"WITH {CELLS} SELECT l_orderkey, round_even(max(rubric_score), 4) AS best_score FROM opts GROUP BY 1")
def best_option_score(spark, d):
    return judged(spark, d).groupBy("l_orderkey").agg(vector.half_even(F.max("rubric_score"), 4).alias("best_score"))


@query("SELECT DISTINCT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS id FROM events WHERE event_type IN ('click', 'purchase')")
def union_of_ids(spark, d):
    """Ids of all rounds, each once."""
    e = table(spark, d, "events").select("user_id", F.floor(seconds() / 3600).cast("bigint").alias("id"), "event_type")
    one = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "id")
    return one("click").union(one("purchase")).distinct()


# --- texts, sizes and replies -------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || chr(10) || p_brand ELSE p_name END AS embedded, '--- Segment 1 ---' || chr(10) || p_name || chr(10) || chr(10) || '--- Segment 2 ---' || chr(10) || p_type AS segments,
'[Frame at ' || CAST(round_even(p_retailprice, 0) AS BIGINT) || 's' || CASE WHEN p_size % 3 > 0 THEN ' — Segment ' || p_size % 3 ELSE '' END || ']' AS image, printf('c%05d_f%02d.jpg', p_partkey, p_size) AS frame, p_name || ' ' || p_brand || ' or ' || p_type AS asked,
CASE WHEN p_size % 5 > 0 THEN 'Transcript lines:' || chr(10) || CASE WHEN p_size % 5 > 1 THEN '- [00:00:' || printf('%02d', p_size) || ' --> 00:01:00] ' || p_name ELSE '- No transcript lines overlap this segment.' END || chr(10) ELSE '' END AS said,
CASE WHEN p_size % 5 > 1 THEN 'Subtitles in this window [t=1.5s, 9.0s):' || chr(10) || '[t=' || p_size || '.0s] ' || p_name ELSE 'No subtitles in this window.' END AS subtitles, p_partkey % 4 AS endpoint FROM part""")
def text_layouts(spark, d):
    """How chunks, frames and subtitles are written for embedders and models."""
    size = F.col("p_size")
    line = F.struct(size.cast("double").alias("start_s"), F.lit(60.0).alias("end_s"), F.col("p_name").alias("text"))
    lines = F.when(size % 5 > 1, F.array(line)).otherwise(F.slice(F.array(line), 1, 0))
    return table(spark, d, "part").select(
        "p_partkey", text.embed_text(F.col("p_name"), F.when(size % 2 == 0, F.col("p_brand"))).alias("embedded"), text.segmented(F.array("p_name", "p_type")).alias("segments"),
        text.image_label(F.col("p_retailprice"), F.when(size % 3 > 0, size % 3)).alias("image"), text.frame_name(F.col("p_partkey"), size).alias("frame"), text.visual_query(F.col("p_name"), F.array("p_brand", "p_type")).alias("asked"),
        text.transcript(lines, size % 5 > 0).alias("said"), text.window_subtitles(lines, F.lit(1.5), F.lit(9.0)).alias("subtitles"), text.endpoint(F.col("p_partkey"), 4).alias("endpoint"),
    )


@query("""SELECT p_partkey, CAST(round_even(w * least(1.0, 9.0 / least(w, h)), 0) AS INT) AS short_w, CAST(round_even(h * least(1.0, 9.0 / least(w, h)), 0) AS INT) AS short_h,
CAST(greatest(1, floor(w * least(1.0, sqrt(50.0 / (w * h))))) AS INT) AS few_w, CAST(greatest(1, floor(h * least(1.0, sqrt(50.0 / (w * h))))) AS INT) AS few_h, round_even(p_retailprice / 7, 1) AS even, p_name[1:7] || '|' || p_type[1:7] AS budget
FROM (SELECT *, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 7 + 1 AS DOUBLE) AS h FROM part)""")
def image_sizes(spark, d):
    w, h = F.col("p_size").cast("double"), (F.col("p_size") % 7 + 1).cast("double")
    short, few = vector.fit_short_side(w, h, 9), vector.fit_pixels(w, h, 50)
    return table(spark, d, "part").select(
        "p_partkey", short[0].alias("short_w"), short[1].alias("short_h"), few[0].alias("few_w"), few[1].alias("few_h"), vector.half_even(F.col("p_retailprice") / 7, 1).alias("even"), F.array_join(vector.char_budget(F.array("p_name", "p_type"), 15), "|").alias("budget")
    )


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS answer, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS sufficient,
CASE doc_id % 5 WHEN 2 THEN 'D' WHEN 4 THEN 'A' WHEN 0 THEN 'B' END AS first, CASE doc_id % 5 WHEN 3 THEN 'x; y' ELSE 'ask' END AS queries FROM documents""")
def rescued_reply(spark, d):
    """Answers and flags of replies that are JSON, nearly JSON, or prose; string lists with a fallback."""
    replies = ['{"answer": "B", "sufficient": true}', 'so "answer": "(c) it", sufficient: no', "The answer is D here", '[" x", "", "y "]', "(A)"]
    said = F.lit(replies[0])
    for k, r in enumerate(replies):
        said = F.when(F.col("doc_id") % 5 == k, r).otherwise(said)
    out = table(spark, d, "documents").select("doc_id", said.alias("said"))
    r = parsing.rescued(F.col("said"))
    return out.select("doc_id", r.answer.alias("answer"), r.sufficient.alias("sufficient"), parsing.first_letter(F.col("said")).alias("first"), parsing.joined(parsing.strings(F.col("said"), F.lit("ask"))).alias("queries"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'broadcast' ELSE 'targeted' END AS strategy, CASE doc_id % 3 WHEN 0 THEN 'p,q' WHEN 1 THEN '' ELSE lang END AS queries, CASE doc_id % 3 WHEN 0 THEN 'r' WHEN 1 THEN '' ELSE 'parse_failed' END AS reasoning,
CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 END AS score, CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN NULL END AS judgment FROM documents""")
def parsed_plan(spark, d):
    """A planner's and a verifier's replies: an unknown strategy is targeted, a plan without queries asks the question, cells that are no number are 0,
    judgments that aren't allowed go."""
    kind = F.col("doc_id") % 3
    plan = F.when(kind == 0, '{"strategy": "odd", "queries": [" p ", "", "q"], "reasoning": "r"}').when(kind == 1, 'go {"strategy": "Broadcast"}').otherwise("no plan")
    cells = F.when(kind == 0, '{" b) x": {"g": 0.5}}').when(kind == 1, '{"B": {"g": "high"}}')
    judged = F.when(kind == 0, '{"b": " TRUE"}').when(kind == 1, '{"B": "maybe"}')
    p = parsing.plan(plan, F.col("lang"))
    score = F.try_element_at(F.try_element_at(parsing.criterion_scores(cells), F.lit("B")), F.lit("g"))
    return table(spark, d, "documents").select("doc_id", p.strategy.alias("strategy"), F.array_join(p.queries, ",").alias("queries"), p.reasoning.alias("reasoning"), score.alias("score"), F.try_element_at(parsing.judgments(judged), F.lit("B")).alias("judgment"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), w AS (SELECT event_id, list_filter([k, lead(k) OVER o, lag(k) OVER o], lambda x: x IS NOT NULL) AS ks FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT event_id, list_filter(ks, lambda x: x < 60)[1:2] AS v FROM w),
p AS (SELECT event_id, CASE WHEN len(v) > 0 THEN list_transform(v, lambda x, i: {'idx': x, 'score': round(1 - (i - 1) * 0.01, 2)}) ELSE list_transform([0, 1], lambda x: {'idx': x, 'score': 1.0::DOUBLE}) END AS p FROM v)
SELECT event_id, CAST(unnest(range(len(p))) AS INT) AS rank, unnest(list_transform(p, lambda x: x.idx)) AS idx, unnest(list_transform(p, lambda x: x.score)) AS score FROM p""")
def listwise_replies(spark, d):
    """Replies that select by the numbers that an event and its neighbours carry in their JSON; numbers from 60 on name nothing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    e = table(spark, d, "events").select("event_id", F.concat_ws(", ", k, F.lead(k).over(w), F.lag(k).over(w)).alias("listed"))
    picked = e.select("event_id", answers.selected(F.concat(F.lit('I take {"selected": ['), "listed", F.lit("]}, I think")), F.lit(60), 2).alias("p"))
    return picked.select("event_id", F.posexplode("p").alias("rank", "p")).select("event_id", "rank", "p.idx", "p.score")


@query("""WITH t AS (SELECT conv_id, list(trim(text) ORDER BY turn, role, text) AS q, count(*) AS n FROM conversations GROUP BY 1),
f AS (SELECT conv_id, n, list_filter(q, lambda x: x <> '') AS q FROM t)
SELECT conv_id, CASE WHEN n % 3 = 1 THEN 'broadcast' ELSE 'targeted' END AS strategy, array_to_string(CASE WHEN n % 3 = 2 THEN ['ask ' || conv_id] ELSE q END, chr(31)) AS queries, CASE WHEN n % 3 = 2 THEN 'parse_failed' ELSE n || ' turns' END AS reasoning FROM f""")
def plan_replies(spark, d):
    """Planners' replies that carry a conversation's whole texts as queries, in JSON amid prose; a third of them breaks off."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s.text).alias("q"), F.count(F.lit(1)).alias("n"))
    said = F.to_json(F.struct(F.when(F.col("n") % 3 == 1, "Broadcast").otherwise("other").alias("strategy"), F.col("q").alias("queries"), F.concat(F.col("n").cast("string"), F.lit(" turns")).alias("reasoning")))
    said = F.concat(F.lit("My plan: "), F.when(F.col("n") % 3 == 2, F.regexp_replace(said, r"\}$", "")).otherwise(said), F.lit(" that is all"))
    p = parsing.plan(said, F.concat(F.lit("ask "), F.col("conv_id").cast("string")))
    return c.select("conv_id", p.strategy.alias("strategy"), F.array_join(p.queries, "\x1f").alias("queries"), p.reasoning.alias("reasoning"))
