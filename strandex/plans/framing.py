"""Registered queries about frames: keyframes of windows and of rounds, whole videos shown to a model, messages with images."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.functions import prompts, text, vector
from strandex.operators import keyframes, messages, retrieval, sequence
from strandex.plans.catalog import ASKED, CHUNKS, HASHED, asked, chunks, query, seconds
from strandex.session import table

EACH = "(SELECT max(vec_id) + 1 FROM embeddings)"


def of_embedding(rows, spark, d):
    """Rows of events with the vector that their id points to, round and round."""
    n = table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).first().n
    return rows.withColumn("chunk_id", F.col("event_id") % (n or 1)).join(chunks(spark, d), "chunk_id")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, CAST(epoch_us(ts) // 432000000000 AS BIGINT) AS idx, event_id, value, CAST(embedding AS DOUBLE[]) AS v FROM events JOIN embeddings ON vec_id = event_id % {EACH} WHERE value >= 3),
s AS (SELECT *, avg((value < 10)::INT) OVER (PARTITION BY user_id, idx) AS share FROM e),
o AS (SELECT *, {HASHED}, row_number() OVER (PARTITION BY user_id, idx ORDER BY event_id) AS rn FROM s WHERE value >= 10 OR share > 0.5),
f AS (SELECT user_id, idx, rn, [event_id] AS ids, [h] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT f.user_id, f.idx, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.event_id) END, CASE WHEN near THEN f.kept ELSE list_append(f.kept, o.h) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.idx = f.idx AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept[greatest(len(f.kept) - 9, 1):], lambda k: bit_count(xor(k, o.h)) <= 22)) > 0 AS near)),
w AS (SELECT user_id, idx, unnest(ids) AS event_id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY rn DESC) = 1)),
l AS (SELECT *, lag(v) OVER (PARTITION BY user_id, idx ORDER BY event_id) AS p FROM w JOIN o USING (user_id, idx, event_id)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR list_dot_product(v, p) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, idx ORDER BY event_id) AS island FROM l),
g AS (SELECT *, (row_number() OVER (PARTITION BY user_id, idx, island ORDER BY event_id) - 1) // 3 AS part FROM i),
heads AS (SELECT user_id, idx, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM g GROUP BY user_id, idx, island, part),
top AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY value DESC, event_id DESC) <= 2),
n AS (SELECT user_id, idx, event_id, CAST(row_number() OVER (PARTITION BY user_id, idx ORDER BY event_id) - 1 AS INT) AS local FROM top)
SELECT *, printf('c%05d_f%02d.jpg', idx, local) AS name FROM n""")
def window_keyframes(spark, d):
    """Dark and blurry frames, near copies and runs of like frames go from five-day windows; two frames a window stay."""
    e = of_embedding(table(spark, d, "events"), spark, d).withColumn("idx", F.floor(seconds() / 432_000).cast("bigint")).withColumn("h", vector.sign_hash(F.col("v_dynamic")))
    return keyframes.window_keyframes(e, "user_id", "event_id", F.col("value") < 3, F.col("value") < 10, "value", "h", "v_dynamic", 0.05, 22, longest=3)


@query(f"""WITH RECURSIVE {CHUNKS}, fr AS (SELECT event_id, event_id % {EACH} AS chunk_id, value, row_number() OVER (PARTITION BY event_id % {EACH} ORDER BY event_id) AS r FROM events),
im AS (SELECT * FROM fr WHERE r <= 2 AND value >= 40), o AS (SELECT *, chunk_id IN (SELECT chunk_id FROM im) AS loads, chunk_id % 2 AS round, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id % 2, chunk_id) AS rn FROM c),
f AS (SELECT video_id, rn, [chunk_id] AS ids, CASE WHEN loads THEN [v] ELSE [] END AS kept FROM o WHERE rn = 1
  UNION ALL SELECT f.video_id, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.chunk_id) END, CASE WHEN near OR NOT loads THEN f.kept ELSE list_append(f.kept, o.v) END
  FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept, lambda k: round(list_dot_product(k, o.v), 6) >= 0.2)) > 0 AS near)),
k AS (SELECT video_id, unnest(ids) AS chunk_id FROM f WHERE rn = (SELECT max(rn) FROM o WHERE o.video_id = f.video_id))
SELECT video_id, CAST(chunk_id % 2 AS INT) AS round, chunk_id, event_id FROM k JOIN im USING (chunk_id)""")
def carried_keyframes(spark, d):
    """Two rounds of a question's chunks: the second is held against what the first had kept, and only chunks with an image that loads count there."""
    n = table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).first().n
    frames = table(spark, d, "events").select("event_id", (F.col("event_id") % (n or 1)).alias("chunk_id"), "value")
    images = keyframes.loadable(frames, ["chunk_id"], ["event_id"], F.col("value") >= 40, 2).select("chunk_id", "event_id")
    state, out = None, None
    for i in range(2):
        new = chunks(spark, d).where(F.col("chunk_id") % 2 == i).withColumn("ord", F.col("chunk_id"))
        got, state = keyframes.accumulated(new, images, state, "video_id", "ord", "v_dynamic", 0.2, ["chunk_id"])
        got = got.select("video_id", F.lit(i).alias("round"), "chunk_id", "event_id")
        out = got if out is None else out.unionByName(got)
    return out


PROMPT = "Question: %s\nOptions:\n%s\nAnswer with one letter."


@query("""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS users FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, CAST(floor(i * (n / 16.0::DOUBLE)) AS BIGINT) AS rn FROM r, (SELECT unnest(range(16)) AS i) WHERE n > 16),
s AS (SELECT user_id, event_id, rn FROM r WHERE n <= 16 UNION ALL SELECT r.user_id, r.event_id, rn FROM r JOIN k USING (user_id, rn)),
f AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS frames, count(*) AS n_frames FROM s GROUP BY 1)
SELECT item_id, user_id, 'Question: ' || text || chr(10) || 'Options:' || chr(10) || '  (A) yes' || chr(10) || '  (B) no' || chr(10) || 'Answer with one letter.' AS prompt, frames, n_frames FROM benchmark JOIN u ON item_id % users = place JOIN f USING (user_id)""")
def direct_question(spark, d):
    """Each benchmark text asks one whole video, of which it is shown up to 16 frames, evenly spread."""
    e = table(spark, d, "events")
    shown = sequence.even_sample_large(e.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 16)
    frames = shown.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda s: s.event_id.cast("string")), ",").alias("frames"), F.count(F.lit(1)).alias("n_frames"))
    users = sequence.position(e.select("user_id").distinct(), ["user_id"], "place")
    n = users.count()
    asked = table(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % max(n, 1)).alias("place")).join(users, "place")
    prompt = F.format_string(PROMPT, F.col("text"), text.option_lines(F.array(F.lit("yes"), F.lit("no"))))
    return asked.join(frames, "user_id").select("item_id", "user_id", prompt.alias("prompt"), "frames", "n_frames")


@query("""WITH q AS (SELECT conv_id, min(text) AS question FROM conversations WHERE turn = 0 GROUP BY 1),
ev AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id, string_agg('--- Segment ' || place || ' ---' || chr(10) || text[1:1200 // n], chr(10) || chr(10) ORDER BY place) AS evidence, count(*) AS n FROM ev GROUP BY 1),
im AS (SELECT event_id % (SELECT max(conv_id) + 1 FROM conversations) AS conv_id, event_id, value, row_number() OVER (PARTITION BY event_id % (SELECT max(conv_id) + 1 FROM conversations) ORDER BY event_id) AS r FROM events WHERE value >= 10),
shown AS (SELECT * FROM im WHERE r <= 6),
seg AS (SELECT conv_id, turn, max(place) AS place FROM ev GROUP BY 1, 2),
p AS (SELECT conv_id, 0 AS a, 0 AS b, 'text' AS kind, 'Question: ' || question || chr(10) || (SELECT count(*) FROM shown s WHERE s.conv_id = q.conv_id) || ' frames, ' || coalesce(t.n, 0) || ' segments' AS text, NULL AS image FROM q LEFT JOIN t USING (conv_id)
  UNION ALL SELECT s.conv_id, r, 0, 'text', '[Frame at ' || CAST(round_even(value, 0) AS BIGINT) || 's' || CASE WHEN g.place IS NOT NULL THEN ' — Segment ' || g.place ELSE '' END || ']', NULL FROM shown s JOIN q USING (conv_id) LEFT JOIN seg g ON g.conv_id = s.conv_id AND g.turn = s.event_id % 8
  UNION ALL SELECT s.conv_id, r, 1, 'image', NULL, 'event' || event_id FROM shown s JOIN q USING (conv_id)
  UNION ALL SELECT conv_id, 100, 0, 'text', coalesce(t.evidence, '') || chr(10) || 'Question: ' || question, NULL FROM q LEFT JOIN t USING (conv_id))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY a, b) - 1 AS INT) AS pos, kind, text, image FROM p""")
def message_parts(spark, d):
    """A conversation's first turn asks about its answers, with up to six frames among them, each labelled by its time and segment."""
    c = table(spark, d, "conversations")
    n = c.agg((F.max("conv_id") + 1).alias("n")).first().n
    samples = c.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("question"))
    evidence = c.where("role = 'assistant'").select("conv_id", F.struct("turn", "role", "text").alias("ord"), F.col("turn").alias("chunk_id"), "text")
    e = table(spark, d, "events").select((F.col("event_id") % (n or 1)).alias("conv_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 8).alias("chunk_id"), F.col("value").alias("ts"), F.when(F.col("value") >= 10, F.concat(F.lit("event"), F.col("event_id"))).alias("image"))
    head = F.concat(F.lit("Question: "), "question", F.lit("\n"), F.col("_n_images").cast("string"), F.lit(" frames, "), F.col("_n_texts").cast("string"), F.lit(" segments"))
    tail = F.concat(text.segmented(F.col("_evidence")), F.lit("\nQuestion: "), "question")
    rows = messages.assembled(samples, evidence, e, "conv_id", head, tail, 6, 1200, labels=True)
    return rows.select("conv_id", F.posexplode("parts").alias("pos", "p")).select("conv_id", "pos", "p.*")


# --- prompts and their replies ------------------------------------------------------------------------------------

TALK = """q AS (SELECT conv_id, list(text ORDER BY turn, role, text) FILTER (role = 'user') AS u, list('[' || turn * 10 || 's-' || (turn * 10 + 9) || 's] ' || text ORDER BY turn, role, text) FILTER (role = 'assistant') AS e, count(*) AS n FROM conversations GROUP BY 1),
t AS (SELECT conv_id, coalesce(u, []) AS u, coalesce(e, []) AS e, n, coalesce(u, [])[1:3] AS c, array_to_string(list_transform(coalesce(u, [])[1:3], lambda x, i: '  (' || chr((64 + i)::INT) || ') ' || x), chr(10)) AS opts FROM q)"""


def talks(spark, d):
    """A conversation's user turns ask (the first is the question, the first three the options), its answers are the evidence."""
    c = table(spark, d, "conversations")
    of = lambda role, said: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "role", "text", said.alias("said"))))), lambda s: s.said)
    head = F.concat(F.lit("["), (F.col("turn") * 10).cast("string"), F.lit("s-"), (F.col("turn") * 10 + 9).cast("string"), F.lit("s] "), "text")
    t = c.groupBy("conv_id").agg(of("user", F.col("text")).alias("u"), of("assistant", head).alias("e"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("c", F.slice("u", 1, 3)).withColumn("question", F.coalesce(F.get("u", F.lit(0)), F.lit("")))


@query(f"""WITH {TALK} SELECT conv_id, 'Question: ' || coalesce(u[1], '') || chr(10) || 'Options:' || chr(10) || opts || chr(10) || chr(10) || 'Evidence:' || chr(10) || array_to_string(list_transform(e, lambda x, i: '  [E' || i || '] ' || x[1:250]), chr(10)) || chr(10) || chr(10) || 'Right: (' || chr((65 + n % 3)::INT) || ') '
|| coalesce(nullif(c[1 + n % 3], ''), '?') || chr(10) || 'Said: (' || CASE WHEN n % 2 = 0 THEN '?' ELSE 'A' END || ') ' || CASE WHEN n % 2 = 0 THEN 'unknown' ELSE coalesce(nullif(c[1], ''), 'unknown') END || chr(10) || chr(10) || 'What does the evidence lack to support the correct answer?' AS prompt,
CASE WHEN n % 2 = 0 AND coalesce(e[1], '') <> '' THEN e[1] ELSE (CASE WHEN n % 2 = 0 THEN '{{"description":""}}' ELSE 'no braces: ' || coalesce(u[1], '') END)[1:200] END AS missing FROM t""")
def missing_facts(spark, d):
    """Prompts about whole evidence, each text cut where the prompt cuts it, and replies with and without JSON."""
    t = talks(spark, d)
    gold, said = F.char(65 + F.col("n") % 3), F.when(F.col("n") % 2 == 1, "A")
    reply = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(F.coalesce(F.get("e", F.lit(0)), F.lit("")).alias("description")))).otherwise(F.concat(F.lit("no braces: "), "question"))
    return t.select("conv_id", prompts.missing_fact_prompt(F.col("question"), F.col("c"), F.col("e"), gold, said).alias("prompt"), prompts.missing_fact(reply).alias("missing"))


@query(f"""WITH {TALK}, r AS (SELECT conv_id, list_sort(list_distinct(list((turn * 10, turn * 10 + 9)))) AS r FROM conversations WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT *, CASE WHEN n % 4 = 0 THEN '' ELSE 'turn ' || n END AS gap, array_to_string(list_transform(r, lambda x: printf('%d:%02d', x[1] // 60, x[1] % 60) || '-' || printf('%d:%02d', x[2] // 60, x[2] % 60)), ', ') AS covered FROM t LEFT JOIN r USING (conv_id))
SELECT conv_id, 'Question: ' || coalesce(u[1], '') || repeat(chr(10), 2) || 'Options:' || chr(10) || opts || repeat(chr(10), 2) || 'Asked before:' || chr(10) || CASE WHEN len(u) > 0 THEN '  "' || array_to_string(u, '" | "') || '"' ELSE '  [spread]' END || chr(10) || '  [spread]'
|| CASE WHEN len(e) > 0 THEN repeat(chr(10), 2) || 'Times seen: ' || covered || repeat(chr(10), 2) || 'Evidence so far, in part:' || chr(10) || array_to_string(list_transform(e[1:5], lambda x, i: '  [E' || i || '] ' || x[1:200]), chr(10)) ELSE '' END
|| CASE WHEN gap <> '' THEN repeat(chr(10), 2) || 'Open: ' || gap ELSE '' END || repeat(chr(10), 2) || 'Give the next plan as JSON.' AS prompt,
array_to_string(list_filter([CASE WHEN n % 3 > 0 THEN 'Weak criteria: coverage' || CASE WHEN n % 3 = 2 THEN ', order' ELSE '' END END, CASE WHEN n % 2 = 0 THEN 'Open options: A, C' END, CASE WHEN gap <> '' THEN 'What is missing: ' || gap END], lambda x: x IS NOT NULL), chr(10)) AS context FROM p""")
def planner_prompts(spark, d):
    t = talks(spark, d).withColumn("gap", F.when(F.col("n") % 4 == 0, "").otherwise(F.concat(F.lit("turn "), F.col("n").cast("string"))))
    none = F.expr("cast(array() as array<string>)")
    weak = F.slice(F.array(F.lit("coverage"), F.lit("order")), F.lit(1), (F.col("n") % 3).cast("int"))
    unknown = F.when(F.col("n") % 2 == 0, F.array(F.lit("A"), F.lit("C"))).otherwise(none)
    return t.select("conv_id", prompts.planner_prompt(F.col("question"), F.col("c"), F.array("u", none), F.col("e"), F.col("gap")).alias("prompt"), prompts.repair_context(weak, unknown, F.col("gap")).alias("context"))


@query("""WITH r AS (SELECT doc_id, text, lang, l.quality AS q, n_chars FROM documents LEFT JOIN labels l USING (doc_id)), v AS (SELECT *, CASE WHEN q = 1 THEN 'sufficient' ELSE 'insufficient' END AS label FROM r)
SELECT doc_id, label, CASE WHEN q IS NULL THEN '' ELSE CASE n_chars % 3 WHEN 0 THEN 'A=verified,B=unclear' WHEN 1 THEN 'B=unclear' ELSE '' END END AS status, CASE WHEN label = 'insufficient' AND q IS NOT NULL THEN nullif(text, '') END AS missing, CASE WHEN q IS NULL THEN '' ELSE lang END AS reasoning FROM v""")
def holistic_verdicts(spark, d):
    """Replies of a verifier without a rubric, about whole texts: labels in any case, statuses that aren't allowed, and replies that break off."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    first = F.when(F.col("n_chars") % 3 == 0, " Verified ").otherwise("odd")
    status = F.when(F.col("n_chars") % 3 < 2, F.create_map(F.lit("a) x"), first, F.lit("B"), F.lit("unclear")))
    label = F.when(F.col("quality") == 1, "SUFFICIENT").otherwise("perhaps")
    reply = F.to_json(F.struct(label.alias("label"), status.alias("option_status"), F.col("text").alias("missing_evidence_analysis"), F.col("lang").alias("reasoning")))
    reply = F.when(F.col("quality").isNotNull(), F.concat(F.lit("Here it is: "), reply)).otherwise(F.substring(reply, 1, 9))
    v = prompts.holistic_verdict(reply)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(v.option_status)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return docs.select("doc_id", v.label.alias("label"), shown.alias("status"), v.missing.alias("missing"), v.reasoning.alias("reasoning"))


@query(f"""WITH {CHUNKS}, {ASKED}, s AS (SELECT q.query_id, c.chunk_id, round(list_dot_product(q.qv[1:32], c.v[1:32]), 6) AS t, round(list_dot_product(q.qv[1:32], c.v[17:48]), 6) AS a, CASE WHEN c.chunk_id % 3 > 0 THEN round(list_dot_product(q.qv[33:64], c.v[33:64]), 6) END AS i FROM q JOIN c USING (video_id)),
b AS (SELECT *, (1 - 0.3::DOUBLE) * t + 0.3::DOUBLE * a AS x FROM s), f AS (SELECT query_id, chunk_id, floor((0.6::DOUBLE * x + (1 - 0.6::DOUBLE) * coalesce(i, x)) * 100000 + 0.5) / 100000 AS score FROM b)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 8""")
def topk_blended(spark, d):
    """Text and speech in one space, images in another where a chunk has one."""
    part = lambda c, i: F.slice(c, i, 32)
    q = asked(spark, d).select("video_id", "query_id", part(F.col("q_vec"), 1).alias("q_text"), part(F.col("q_vec"), 33).alias("q_image"))
    c = chunks(spark, d).select("video_id", "chunk_id", part(F.col("v_dynamic"), 1).alias("text"), part(F.col("v_dynamic"), 17).alias("speech"), F.when(F.col("chunk_id") % 3 > 0, part(F.col("v_dynamic"), 33)).alias("image"))
    channels = (("q_text", "text"), ("q_text", "speech"), ("q_image", "image"))
    top = retrieval.nearest(q, c, "video_id", ["query_id"], 8, channels, lambda t, a, i: retrieval.blended(t, a, i, 0.3, 0.6, 5))
    return top.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))
