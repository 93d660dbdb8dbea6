"""The registered queries: each applies an operator to the whole of the tables that stand in for its input, beside its SQL.

embeddings are chunks of a video (label) with their vector; events are a user's frames or cues in time; documents, labels and lineitem stand
in for records, gold answers and scores. Thresholds are parameters, set here so that synthetic vectors give results of both kinds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.functions import parsing, text, vector
from strandex.operators import dedup, joins, retrieval, sequence, verdict
from strandex.plans import providers
from strandex.plans import retrieval as plans
from strandex.scratch import written
from strandex.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared inputs ------------------------------------------------------------------------------------------------


def chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v_dynamic"))


def asked(spark, d):
    """The query set: every chunk whose id is divisible by 20 asks its video."""
    return chunks(spark, d).where("chunk_id % 20 = 0").select("video_id", F.col("chunk_id").alias("query_id"), F.col("v_dynamic").alias("q_vec"))


def seconds(column="ts"):
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000).cast("double")


def cues(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("cue_id"), seconds().alias("start_s"), (seconds() + F.col("value") * 60).alias("end_s"), F.col("event_type").alias("text"))


def hour_windows(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(seconds() / 3600).cast("bigint").alias("idx")).distinct()
    return e.select("user_id", "idx", (F.col("idx") * 3600).cast("double").alias("t_start"), ((F.col("idx") + 1) * 3600).cast("double").alias("t_end"))


CHUNKS = "c AS (SELECT label AS video_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ASKED = "q AS (SELECT label AS video_id, vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0)"
SCORED = f"{CHUNKS}, {ASKED}, s AS (SELECT q.query_id, c.chunk_id, round(list_dot_product(q.qv, c.v), 6) AS score, round(list_dot_product(q.qv[1:32], c.v[1:32]), 6) AS half FROM q JOIN c USING (video_id))"
TOP8 = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"
CUES = "cue AS (SELECT user_id, event_id AS cue_id, epoch_us(ts) / 1000000.0 AS start_s, epoch_us(ts) / 1000000.0 + value * 60 AS end_s, event_type AS text FROM events)"
WINDOWS = "w AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS idx FROM events), win AS (SELECT *, idx * 3600.0 AS t_start, (idx + 1) * 3600.0 AS t_end FROM w)"

# --- retrieval ----------------------------------------------------------------------------------------------------


HALVES = (("q_vec", "v_dynamic"), ("q_half", "v_half"))


def halved(queries, chunks_):
    """Both sides with the first 32 elements of their vectors as a second channel."""
    half = lambda c: F.slice(c, 1, 32)
    return queries.withColumn("q_half", half(F.col("q_vec"))), chunks_.withColumn("v_half", half(F.col("v_dynamic")))


def nearest(spark, d, k, where="true", **more):
    """The k best chunks of each query, among those for which where holds."""
    top = retrieval.nearest(asked(spark, d), chunks(spark, d).where(where), "video_id", ["query_id"], k, **more)
    return top.select("video_id", "query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SCORED} SELECT query_id, chunk_id, score, rank FROM (SELECT *, {TOP8} AS rank FROM s) WHERE rank <= 8")
def topk_cosine(spark, d):
    return nearest(spark, d, 8).drop("video_id")


@query(f"WITH {SCORED}, f AS (SELECT query_id, chunk_id, round(0.6 * score + 0.4 * half, 5) AS score FROM s) SELECT query_id, chunk_id, score, rank FROM (SELECT *, {TOP8} AS rank FROM f) WHERE rank <= 8")
def topk_fused_score(spark, d):
    top = retrieval.nearest(*halved(asked(spark, d), chunks(spark, d)), "video_id", ["query_id"], 8, HALVES, lambda s, half: retrieval.half_up(0.6 * s + 0.4 * half, 5))
    return top.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SCORED}, f AS (SELECT query_id, chunk_id, round(score, 1) + 0.0 AS score FROM s) SELECT query_id, chunk_id, score, rank FROM (SELECT *, {TOP8} AS rank FROM f) WHERE rank <= 24")
def topk_tie_stable(spark, d):
    return nearest(spark, d, 24, combine=lambda s: retrieval.half_up(s, 1)).drop("video_id")


@query(f"""WITH {SCORED}, f AS (SELECT *, {TOP8} AS coarse FROM s), r AS (SELECT *, round(1 / (1 + exp(-5 * half)), 6) AS rerank_score FROM f WHERE coarse <= 50)
SELECT query_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM r) WHERE rank <= 10""")
def two_stage_rerank(spark, d):
    q, c = halved(asked(spark, d), chunks(spark, d))
    first = retrieval.nearest(q, c, "video_id", ["query_id"], 50, rank="coarse_rank")
    pairs = first.join(q.select("query_id", "q_half"), "query_id").join(c.select("chunk_id", "v_half"), "chunk_id")
    second = F.round(vector.sigmoid(5 * F.round(vector.dot(F.col("q_half"), F.col("v_half")), 6)), 6)
    r = retrieval.top_k(pairs.withColumn("rerank_score", second), ["query_id"], 10, score="rerank_score")
    return r.select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {SCORED}, p AS (SELECT *, 1 + chunk_id % 2 AS pool FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, pool ORDER BY score DESC, chunk_id) AS r FROM p)
SELECT query_id, pool, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool, chunk_id) AS rank FROM t WHERE (pool = 1 AND r <= 8) OR (pool = 2 AND r <= 4)) WHERE rank <= 8""")
def multi_pool_merge(spark, d):
    fine, coarse = nearest(spark, d, 8, "chunk_id % 2 = 0").drop("rank"), nearest(spark, d, 4, "chunk_id % 2 = 1").drop("rank")
    return retrieval.merged([fine, coarse], ["query_id"], 8).select("query_id", F.col("pool").cast("bigint").alias("pool"), "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


COARSE = f"""WITH {CHUNKS}, {ASKED}, win AS (SELECT video_id, chunk_id AS window_id, v FROM c WHERE chunk_id % 7 = 0),
ws AS (SELECT query_id, video_id, window_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv, win.v), 6) DESC, window_id) AS r FROM q JOIN win USING (video_id)),
inside AS (SELECT DISTINCT query_id, c.chunk_id FROM ws JOIN c USING (video_id) WHERE r <= 2 AND c.chunk_id < window_id + 60 AND c.chunk_id + 1 > window_id),
s AS (SELECT q.query_id, c.chunk_id, round(list_dot_product(q.qv, c.v), 6) AS score, i.chunk_id IS NOT NULL AS in_window FROM q JOIN c USING (video_id) LEFT JOIN inside i ON i.query_id = q.query_id AND i.chunk_id = c.chunk_id)"""


def in_windows(spark, d):
    c = chunks(spark, d).withColumns({"start_time": F.col("chunk_id"), "end_time": F.col("chunk_id") + 1})
    w = chunks(spark, d).where("chunk_id % 7 = 0").select("video_id", F.col("chunk_id").alias("window_id"), F.col("v_dynamic").alias("w_vec"), F.col("chunk_id").alias("w_start"), (F.col("chunk_id") + 60).alias("w_end"))
    return retrieval.in_best_windows(asked(spark, d), w, c, "video_id", "query_id", 2).select("query_id", "chunk_id")


def in_window_scores(spark, d):
    pairs = in_windows(spark, d).join(asked(spark, d), "query_id").join(chunks(spark, d).select("chunk_id", "v_dynamic"), "chunk_id")
    return pairs.select("query_id", "chunk_id", F.round(vector.dot(F.col("q_vec"), F.col("v_dynamic")), 6).alias("score"))


@query(f"{COARSE} SELECT query_id, chunk_id, score, rank FROM (SELECT *, {TOP8} AS rank FROM s WHERE in_window) WHERE rank <= 8")
def coarse_to_fine_strict(spark, d):
    return retrieval.top_k(in_window_scores(spark, d), ["query_id"], 8).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"{COARSE}, t AS (SELECT *, round(score, 1) + 0.0 AS tied FROM s) SELECT query_id, chunk_id, tied AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tied DESC, NOT in_window, chunk_id) AS rank FROM t) WHERE rank <= 8")
def coarse_to_fine_compat(spark, d):
    """Windows only break ties. What isn't in a window can only be among the best as one of the best by score and id, so no other pair is made."""
    inside = in_window_scores(spark, d).withColumn("score", F.round("score", 1) + 0.0)
    top = nearest(spark, d, 8, combine=lambda s: retrieval.half_up(s, 1)).select("query_id", "chunk_id", "score")
    both = inside.withColumn("_in", F.lit(0)).unionByName(top.join(inside, ["query_id", "chunk_id"], "left_anti").withColumn("_in", F.lit(1)))
    return retrieval.top_k(both, ["query_id"], 8, ties=("_in", "chunk_id")).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {SCORED}, t AS (SELECT *, {TOP8} AS rank FROM s), k AS (SELECT query_id, chunk_id, rank, (SELECT label FROM embeddings e WHERE e.vec_id = query_id) AS video_id FROM t WHERE rank <= 8)
SELECT video_id, query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY query_id, rank) AS r FROM k) WHERE r = 1""")
def cross_query_first_seen(spark, d):
    top = nearest(spark, d, 8)
    return retrieval.first_seen(top.withColumnRenamed("query_id", "q_pos"), ["video_id"]).select("video_id", F.col("q_pos").alias("query_id"), "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SCORED}, u AS (SELECT * FROM s WHERE chunk_id % 20 <> 0) SELECT query_id, chunk_id, score, rank FROM (SELECT *, {TOP8} AS rank FROM u) WHERE rank <= 8")
def retrieve_unseen(spark, d):
    seen = asked(spark, d).select(F.col("query_id").alias("chunk_id"))
    top = retrieval.nearest(asked(spark, d), retrieval.unseen(chunks(spark, d), seen, ["chunk_id"]), "video_id", ["query_id"], 8)
    return top.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {CHUNKS}, {ASKED}, m AS (SELECT q.query_id, max(round(list_dot_product(q.qv, c.v), 6)) AS nearest FROM q JOIN c USING (video_id) WHERE c.chunk_id % 20 <> 0 GROUP BY 1)
SELECT query_id, nearest, nearest < 0.25 AS kept FROM m""")
def query_drift_filter(spark, d):
    s = nearest(spark, d, 1, "chunk_id % 20 <> 0").select("query_id", F.col("score").alias("nearest"))
    return s.withColumn("kept", F.col("nearest") < 0.25)


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS k FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn, max(CASE WHEN b.k IS NULL THEN NULL WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END) AS nearest
      FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2)
SELECT conv_id, turn, round(nearest, 6) AS nearest, coalesce(nearest < 0.1, TRUE) AS kept FROM p""")
def query_jaccard_filter(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", vector.tokens(F.col("text")).alias("k"))
    before = t.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("k").alias("_k"))
    p = t.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("_t") < F.col("turn")), "left").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("_k").isNotNull(), vector.jaccard(F.col("k"), F.col("_k")))).alias("nearest"))
    return p.select("conv_id", "turn", F.round("nearest", 6).alias("nearest"), F.coalesce(F.col("nearest") < 0.1, F.lit(True)).alias("kept"))


# --- sequences ----------------------------------------------------------------------------------------------------

SESSIONS = f"""WITH {CHUNKS}, l AS (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY chunk_id) AS p FROM c),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR list_dot_product(v, p) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY chunk_id) AS island FROM l),
g AS (SELECT *, (row_number() OVER (PARTITION BY video_id, island ORDER BY chunk_id) - 1) // 4 AS part FROM i),
raw AS (SELECT video_id, chunk_id, v, dense_rank() OVER (PARTITION BY video_id ORDER BY island, part) - 1 AS raw_group FROM g),
size AS (SELECT video_id, raw_group, count(*) AS n FROM raw GROUP BY 1, 2),
head AS (SELECT *, CASE WHEN n >= 3 OR row_number() OVER (PARTITION BY video_id ORDER BY raw_group) = 1 THEN 1 ELSE 0 END AS h FROM size),
fold AS (SELECT video_id, raw_group, sum(h) OVER (PARTITION BY video_id ORDER BY raw_group) - 1 AS chunk_idx FROM head),
m AS (SELECT raw.*, CAST(chunk_idx AS BIGINT) AS chunk_idx FROM raw JOIN fold USING (video_id, raw_group))"""


def sessions(spark, d):
    return sequence.sessions(chunks(spark, d), "video_id", ["chunk_id"], "v_dynamic", 0.05, 4)


@query(f"{SESSIONS} SELECT video_id, chunk_id, CAST(raw_group AS BIGINT) AS raw_group FROM raw")
def similarity_sessionize(spark, d):
    return sessions(spark, d).select("video_id", "chunk_id", F.col("raw_group").cast("bigint").alias("raw_group"))


@query(f"{SESSIONS} SELECT video_id, chunk_id, chunk_idx FROM m")
def sessionize_fold_short(spark, d):
    return sequence.fold_short(sessions(spark, d), "video_id", 3).select("video_id", "chunk_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"))


@query(f"""{SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_idx ORDER BY chunk_id) - 1 AS rn, count(*) OVER (PARTITION BY video_id, chunk_idx) AS n FROM m)
SELECT video_id, chunk_idx, count(*) AS size, min(chunk_id) AS t_start, max(chunk_id) + 1 AS t_end, max(CASE WHEN rn = n // 2 THEN chunk_id END) AS center FROM r GROUP BY 1, 2""")
def session_attributes(spark, d):
    rows = sequence.fold_short(sessions(spark, d), "video_id", 3).withColumn("ts", F.col("chunk_id"))
    return sequence.attributes(rows, "video_id", ["chunk_id"], "ts").withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@query(f"""{SESSIONS}, r AS (SELECT *, v[1] AS sharp, row_number() OVER (PARTITION BY video_id, chunk_idx ORDER BY chunk_id) - 1 AS rn, count(*) OVER (PARTITION BY video_id, chunk_idx) AS n FROM m)
SELECT video_id, chunk_idx, coalesce(max(CASE WHEN rn = n // 2 AND sharp >= 0.1 THEN chunk_id END), arg_max(chunk_id, (sharp, -rn))) AS keyframe FROM r GROUP BY 1, 2""")
def group_keyframe_pick(spark, d):
    rows = sequence.fold_short(sessions(spark, d), "video_id", 3).withColumn("sharp", F.get("v_dynamic", F.lit(0)).cast("double"))
    return sequence.keyframe(rows, "video_id", ["chunk_id"], "sharp", 0.1).withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, event_id, value FROM events)
SELECT user_id, h, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY value DESC NULLS LAST, event_id DESC) AS r FROM e) WHERE r <= 2""")
def top_sharpest(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(seconds() / 3600).cast("bigint").alias("h"), "event_id", "value")
    return sequence.sharpest(e, ["user_id", "h"], "event_id", "value", 2).select("user_id", "h", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, value < 10 AS bad FROM events), s AS (SELECT *, avg(CAST(coalesce(bad, TRUE) AS INT)) OVER (PARTITION BY user_id) AS share FROM e)
SELECT user_id, event_id FROM s WHERE NOT coalesce(bad, TRUE) OR share > 0.5""")
def failsafe_filter(spark, d):
    return sequence.unless_most(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], F.col("value") < 10).select("user_id", "event_id")


PYRAMID = """WITH l1 AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS idx, CAST((epoch_us(ts) // 3600000000) * 3600 AS DOUBLE) AS t_start,
  max(epoch_us(ts) / 1000000.0) + 1 AS t_end, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text, count(*) AS n FROM events GROUP BY 1, 2, 3),
"""


def layer(of: str, to: str, span: int) -> str:
    return f"{to} AS (SELECT user_id, CAST(floor(t_start / {span}) AS BIGINT) AS idx, CAST(floor(t_start / {span}) * {span} AS DOUBLE) AS t_start, max(t_end) AS t_end, string_agg(text, ' ' ORDER BY t_start) AS text, CAST(sum(n) AS BIGINT) AS n FROM {of} GROUP BY 1, 2, 3)"


LAYERS = [layer("l1", "l2", 10800), layer("l2", "l3", 64800), layer("l3", "l4", 216000)]
SHOWN = "SELECT user_id, idx, t_start, round(t_end, 3) AS t_end, text, n FROM "


def pyramid(spark, d, upto):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", seconds().alias("s"))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "event_id", "event_type"))), lambda x: x.event_type), " ")
    out = sequence.tumbling(e, ["user_id"], F.col("s"), 3600, (F.max("s") + 1).alias("t_end"), words.alias("text"), F.count(F.lit(1)).alias("n")).withColumn("t_start", (F.col("idx") * 3600).cast("double"))
    for span in (10800, 64800, 216000)[: upto - 1]:
        out = sequence.roll_up(out, ["user_id"], span)
    return out.select("user_id", "idx", F.col("t_start").cast("double").alias("t_start"), F.round("t_end", 3).alias("t_end"), "text", "n")


@query(PYRAMID.rstrip().rstrip(",") + SHOWN.join([" ", "l1"]))
def l1_tumbling(spark, d):
    return pyramid(spark, d, 1)


@query(PYRAMID + ", ".join(LAYERS[:1]) + " " + SHOWN + "l2")
def pyramid_l2(spark, d):
    return pyramid(spark, d, 2)


@query(PYRAMID + ", ".join(LAYERS[:2]) + " " + SHOWN + "l3")
def pyramid_l3(spark, d):
    return pyramid(spark, d, 3)


@query(PYRAMID + ", ".join(LAYERS) + " " + SHOWN + "l4")
def pyramid_l4(spark, d):
    return pyramid(spark, d, 4)


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY user_id) // 8) AS step FROM events)
SELECT user_id, event_id FROM r WHERE rn % step = 0 AND rn // step < 8""")
def broadcast_stride_sample(spark, d):
    return sequence.stride_sample(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, CAST(floor(i * (n / 12.0::DOUBLE)) AS BIGINT) AS rn FROM r, (SELECT unnest(range(12)) AS i) WHERE n > 12)
SELECT user_id, event_id FROM r WHERE n <= 12 UNION ALL SELECT r.user_id, r.event_id FROM r JOIN k USING (user_id, rn)""")
def even_downsample(spark, d):
    return sequence.even_sample(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 12).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def per_key_cap(spark, d):
    return sequence.first_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(event_id), user_id LIMIT 10)")
def distinct_key_cap(spark, d):
    return sequence.first_keys(table(spark, d, "events"), "user_id", "event_id", 10).select("event_id", "user_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sample_idx FROM documents WHERE lang IN ('de', 'fr')")
def filtered_position(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id")
    return sequence.position(docs, ["doc_id"]).select("doc_id", "sample_idx")


@query("SELECT user_id, bool_or(event_type = 'purchase') AS has_speech, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def any_flag_per_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("has_speech"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT CAST(floor(epoch_us(ts) / 4000000) AS BIGINT) AS window_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def fixed_chunks(spark, d):
    return sequence.tumbling(table(spark, d, "events"), [], seconds(), 4, F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).withColumnRenamed("idx", "window_id")


# --- dedup --------------------------------------------------------------------------------------------------------

GREEDY = f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS rn FROM c WHERE %s),
f AS (SELECT video_id, rn, [chunk_id] AS ids, [v] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT f.video_id, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.chunk_id) END, CASE WHEN near THEN f.kept ELSE list_append(f.kept, o.v) END
  FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept, lambda k: round(list_dot_product(k, o.v), 6) >= 0.2)) > 0 AS near)),
k AS (SELECT video_id, unnest(ids) AS chunk_id FROM f WHERE rn = (SELECT max(rn) FROM o WHERE o.video_id = f.video_id))
SELECT video_id, chunk_id FROM k"""


@query(GREEDY % "TRUE")
def greedy_dedup(spark, d):
    return dedup.greedy_similarity(chunks(spark, d), "video_id", "chunk_id", "v_dynamic", 0.2)


@query(GREEDY % "TRUE")
def greedy_dedup_blocks(spark, d):
    return dedup.dedup_large(chunks(spark, d), "video_id", "chunk_id", "v_dynamic", 0.2)


HASHED = "list_sum(list_transform(range(60), lambda i: CASE WHEN v[i + 1] > 0 THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT AS h"


@query(f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT video_id, chunk_id, {HASHED}, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS rn FROM c),
f AS (SELECT video_id, rn, [chunk_id] AS ids, [h] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT f.video_id, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.chunk_id) END, CASE WHEN near THEN f.kept ELSE list_append(f.kept, o.h) END
  FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept[greatest(len(f.kept) - 9, 1):], lambda k: bit_count(xor(k, o.h)) <= 24)) > 0 AS near))
SELECT video_id, unnest(ids) AS chunk_id FROM f WHERE rn = (SELECT max(rn) FROM o WHERE o.video_id = f.video_id)""")
def windowed_hash_dedup(spark, d):
    rows = chunks(spark, d).withColumn("h", vector.sign_hash(F.col("v_dynamic")))
    return dedup.recent_hashes(rows, "video_id", "chunk_id", "h", 24, 10)


@query(f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT video_id, chunk_id, v, {HASHED}, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS rn FROM c),
f AS (SELECT video_id, rn, [chunk_id] AS ids, [{{'h': h, 'v': v}}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT f.video_id, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.chunk_id) END, CASE WHEN near THEN f.kept ELSE list_append(f.kept, {{'h': o.h, 'v': o.v}}) END
  FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept, lambda k: bit_count(xor(k.h, o.h)) <= 18 OR round(list_dot_product(k.v, o.v), 6) >= 0.3)) > 0 AS near))
SELECT video_id, unnest(ids) AS chunk_id FROM f WHERE rn = (SELECT max(rn) FROM o WHERE o.video_id = f.video_id)""")
def two_gate_dedup(spark, d):
    rows = chunks(spark, d).withColumn("h", vector.sign_hash(F.col("v_dynamic")))
    return dedup.two_gates(rows, "video_id", "chunk_id", "h", "v_dynamic", 18, 0.3)


@query(f"""WITH {CHUNKS}, h AS (SELECT *, list_sum(list_transform(range(60), lambda i: CASE WHEN v[i + 1] > 0 THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT AS h FROM c)
SELECT a.chunk_id AS a, b.chunk_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM h a JOIN h b ON a.video_id = b.video_id AND a.chunk_id % 20 = 0 AND a.chunk_id <> b.chunk_id WHERE bit_count(xor(a.h, b.h)) <= 20""")
def hash_neighbours(spark, d):
    h = chunks(spark, d).select("video_id", "chunk_id", vector.sign_hash(F.col("v_dynamic")).alias("h"))
    pair = h.where("chunk_id % 20 = 0").alias("x").join(h.alias("y"), "video_id").where("x.chunk_id <> y.chunk_id")
    return pair.select(F.col("x.chunk_id").alias("a"), F.col("y.chunk_id").alias("b"), vector.hamming(F.col("x.h"), F.col("y.h")).alias("distance")).where("distance <= 20")


# --- joins --------------------------------------------------------------------------------------------------------


@query(f"WITH {CUES}, {WINDOWS} SELECT user_id, idx, count(*) AS n, min(cue_id) AS first_cue FROM cue JOIN win USING (user_id) WHERE end_s >= t_start AND start_s <= t_end GROUP BY 1, 2")
def overlap_join_closed(spark, d):
    return joins.overlapping(cues(spark, d), hour_windows(spark, d), "user_id", 3600).groupBy("user_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("cue_id").alias("first_cue"))


@query(f"WITH {CUES}, {WINDOWS} SELECT user_id, idx, count(cue_id) AS n, coalesce(string_agg(text, '; ' ORDER BY start_s, cue_id), 'No subtitles in this window.') AS said FROM win LEFT JOIN cue USING (user_id) WHERE cue_id IS NULL OR (end_s > t_start AND start_s < t_end) GROUP BY 1, 2")
def overlap_join_open(spark, d):
    p = joins.overlapping(cues(spark, d), hour_windows(spark, d), "user_id", 3600, closed=False)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "cue_id", "text"))), lambda s: s.text), "; ")
    found = p.groupBy("user_id", "idx").agg(F.count(F.lit(1)).alias("n"), said.alias("said"))
    return hour_windows(spark, d).select("user_id", "idx").join(found, ["user_id", "idx"], "left").select("user_id", "idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("said", F.lit("No subtitles in this window.")).alias("said"))


@query(f"""WITH {CUES}, {WINDOWS}, s AS (SELECT user_id, idx, string_agg(text, ' ' ORDER BY start_s, cue_id) AS speech FROM cue JOIN win USING (user_id) WHERE end_s >= t_start AND start_s <= t_end GROUP BY 1, 2)
SELECT user_id, idx, CASE WHEN length(speech) > 40 THEN regexp_replace(speech[1:40], ' [^ ]*$', '') || '…' ELSE speech END AS speech FROM s""")
def overlap_truncated_text(spark, d):
    p = joins.overlapping(cues(spark, d), hour_windows(spark, d), "user_id", 3600)
    return joins.speech_of(p, ["user_id", "idx"], ["start_s", "cue_id"], "text").select("user_id", "idx", text.cut_at_word(F.col("speech"), 40).alias("speech"))


@query("SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS idx, event_id FROM events")
def point_in_window(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(seconds() / 3600).cast("bigint").alias("idx"))
    return e.join(hour_windows(spark, d), ["user_id", "idx"]).select("user_id", "idx", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_semi_join(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.members(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'bank_missing' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def bank_missing_left_join(spark, d):
    return joins.with_bank(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


RULES = [(["thing", "these"], "causal"), (["then", "order"], "temporal"), (["here"], "spatial"), (["and"], "action")]


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%thing%' OR lower(text) LIKE '%these%' THEN 'causal' WHEN lower(text) LIKE '%then%' OR lower(text) LIKE '%order%' THEN 'temporal' WHEN lower(text) LIKE '%here%' THEN 'spatial' WHEN lower(text) LIKE '%and%' THEN 'action' ELSE lang END AS kind FROM documents")
def keyword_route(spark, d):
    return table(spark, d, "documents").select("doc_id", joins.route(F.col("text"), RULES, F.col("lang")).alias("kind"))


@query("""WITH b AS (SELECT c_custkey, coalesce(l.quality, -1) AS quality, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS segment FROM customer LEFT JOIN labels l ON l.doc_id = c_custkey)
SELECT c_custkey, segment, quality FROM b""")
def ordered_lookup(spark, d):
    """Rows with the 1-based place of their key in its list; those without a partner stay."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    seg = c.withColumn("segment", F.row_number().over(sequence.Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("bigint"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("c_custkey"), "quality")
    return seg.join(labels, "c_custkey", "left").select("c_custkey", "segment", F.coalesce("quality", F.lit(-1)).alias("quality"))


# --- verdicts and reports -----------------------------------------------------------------------------------------

CELLS = """cells AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS opt, 'd' AS criterion, l_discount * 10 AS score, 1.0 AS weight FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 't', l_tax * 12.5, 0.5 FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'q', l_quantity / 50, NULL FROM lineitem),
scores AS (SELECT l_orderkey, opt, sum(coalesce(weight, 1) * score) / sum(coalesce(weight, 1)) AS rubric_score FROM cells GROUP BY 1, 2),
said AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS opt, min(CASE l_returnflag WHEN 'R' THEN 'true' ELSE 'false' END) AS said FROM lineitem GROUP BY 1, 2),
opts AS (SELECT l_orderkey, opt, round(rubric_score, 9) AS rubric_score, CASE WHEN round(rubric_score, 9) < 0.45 THEN 'unknown' ELSE said END AS judgment FROM scores JOIN said USING (l_orderkey, opt)),
v AS (SELECT l_orderkey, count(*) FILTER (judgment = 'true') AS n_true, count(*) FILTER (judgment = 'false') AS n_false, count(*) FILTER (judgment = 'unknown') AS n_unknown,
  max(CASE WHEN judgment = 'true' THEN rubric_score END) AS ts, max(CASE WHEN judgment = 'unknown' THEN rubric_score END) AS us, max(rubric_score) AS best FROM opts GROUP BY 1),
lab AS (SELECT *, CASE WHEN n_true = 1 AND n_unknown = 0 THEN 'FULLY_SUFFICIENT' WHEN n_true = 1 AND n_unknown > 0 AND round(ts - us, 9) >= 0.2 THEN 'ANSWER_SUFFICIENT' ELSE 'INSUFFICIENT' END AS label FROM v)"""


def cells(spark, d):
    x = table(spark, d, "lineitem")
    cell = lambda name, score, weight: F.struct(F.lit(name).alias("criterion"), score.cast("double").alias("score"), F.lit(weight).cast("double").alias("weight"))
    three = F.array(cell("d", F.col("l_discount") * 10, 1.0), cell("t", F.col("l_tax") * 12.5, 0.5), cell("q", F.col("l_quantity") / 50, None))
    return x.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("opt"), F.explode(three).alias("c")).select("l_orderkey", "opt", "c.*")


def judged(spark, d):
    x = table(spark, d, "lineitem")
    said = x.groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("opt")).agg(F.min(F.when(F.col("l_returnflag") == "R", "true").otherwise("false")).alias("said"))
    s = verdict.option_scores(cells(spark, d), ["l_orderkey", "opt"]).withColumn("rubric_score", F.round("rubric_score", 9))
    return s.join(said, ["l_orderkey", "opt"]).withColumn("judgment", verdict.enforced(F.col("rubric_score"), F.col("said"), 0.45))


@query(f"WITH {CELLS} SELECT l_orderkey, opt, rubric_score, judgment FROM opts")
def option_weighted_score(spark, d):
    return judged(spark, d).select("l_orderkey", "opt", "rubric_score", "judgment")


@query(f"WITH {CELLS} SELECT l_orderkey, label, n_true, n_false, n_unknown, round(best, 6) AS best_score FROM lab")
def verdict_label(spark, d):
    return verdict.verdicts(judged(spark, d), "l_orderkey").select("l_orderkey", "label", "n_true", "n_false", "n_unknown", F.round("best_score", 6).alias("best_score"))


@query(f"""WITH {CELLS} SELECT l_orderkey, criterion, round(avg(score), 6) AS mean_score FROM cells JOIN opts USING (l_orderkey, opt) JOIN lab USING (l_orderkey)
WHERE judgment = 'unknown' AND label = 'INSUFFICIENT' GROUP BY 1, 2 HAVING round(avg(score), 9) < 0.5""")
def weak_criteria(spark, d):
    options = written(judged(spark, d), "judged")
    weak = verdict.weak_criteria(cells(spark, d), options, verdict.verdicts(options, "l_orderkey"), "l_orderkey", "opt", 0.5)
    return weak.withColumn("mean_score", F.round("mean_score", 6))


def results(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ids = F.array((F.col("doc_id") % 7), (F.col("doc_id") % 5), (F.col("doc_id") % 3))
    return docs.select(F.col("source").alias("pipeline"), F.col("lang").alias("question_type"), (F.col("quality") == 1).alias("correct"), ids.alias("evidence_chunk_ids"), (F.col("n_chars") / 1000).alias("elapsed"), F.when(F.col("quality") == 1, "A").otherwise("").alias("pred_text"), F.lit("A").alias("gold"), F.when(F.col("quality") == 1, "A").alias("pred_letter"))


RESULTS = "r AS (SELECT source AS pipeline, lang AS question_type, quality, n_chars / 1000 AS elapsed, len(list_distinct([doc_id % 7, doc_id % 5, doc_id % 3])) AS e FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {RESULTS} SELECT pipeline, count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct, round(avg(quality), 6) AS accuracy, round(avg(e), 6) AS avg_evidence,
CAST(ceil(avg(e)) AS BIGINT) AS ceil_evidence, round(sum(elapsed), 6) AS total_s, round(avg(elapsed), 6) AS avg_s FROM r GROUP BY 1""")
def pipeline_summary(spark, d):
    return verdict.summarise(results(spark, d))


@query(f"""WITH {RESULTS} SELECT CASE WHEN grouping(question_type) = 1 THEN '__overall__' ELSE question_type END AS task, count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct,
round(sum(quality) / count(*), 6) AS accuracy, CASE WHEN grouping(question_type) = 0 THEN count(*) FILTER (quality = 0) END AS no_letter FROM r GROUP BY ROLLUP (question_type)""")
def task_accuracy_rollup(spark, d):
    return verdict.task_accuracy(results(spark, d))


@query(f"WITH {RESULTS} SELECT pipeline, {', '.join(f"round(avg(quality) FILTER (question_type = '{x}'), 6) AS {x}" for x in ('de', 'en', 'es', 'fr'))}, round(avg(quality), 6) AS Overall FROM r GROUP BY 1")
def accuracy_pivot(spark, d):
    return verdict.accuracy_pivot(results(spark, d), "pipeline", "question_type")


@query("""WITH l AS (SELECT label AS video_id, 1 + vec_id % 3 AS layer, CAST(vec_id AS DOUBLE) AS end_time FROM embeddings), g AS (SELECT video_id, max(end_time) AS duration, count(*) FILTER (layer = 1) AS l1, count(*) FILTER (layer = 2) AS l2, count(*) FILTER (layer = 3) AS l3, count(*) FILTER (layer = 4) AS l4 FROM l GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN l1 > 0 THEN '1' END, CASE WHEN l2 > 0 THEN '2' END, CASE WHEN l3 > 0 THEN '3' END, CASE WHEN l4 > 0 THEN '4' END], lambda x: x IS NOT NULL), ',') AS layers_present FROM g""")
def layer_counts(spark, d):
    rows = chunks(spark, d).select("video_id", (1 + F.col("chunk_id") % 3).alias("layer"), F.col("chunk_id").cast("double").alias("end_time"))
    return verdict.layer_counts(rows, "video_id")


@query("SELECT label AS video_id, CAST(pos AS INT) AS pos, round(avg(value), 6) AS value FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS value FROM embeddings) GROUP BY 1, 2")
def mean_pool_vectors(spark, d):
    return verdict.mean_pool(chunks(spark, d), ["video_id"], "v_dynamic").withColumn("value", F.round("value", 6))


# --- scalars ------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 10, 0) AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS hms, printf('%d:%02d', s // 60, s % 60) AS ms FROM s""")
def fmt_hms(spark, d):
    x = F.col("l_extendedprice") / 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.hms(x).alias("hms"), text.minutes(text.whole(x)).alias("ms"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(upper(text), '\\b([A-Z])\\b', 1), lambda c: c IN ('A', 'B', 'C', 'D')) AS c FROM documents)
SELECT doc_id, c[1] AS letter FROM t""")
def parse_letter(spark, d):
    return table(spark, d, "documents").select("doc_id", parsing.answer_letter(F.col("text"), F.lit(4)).alias("letter"))


@query("SELECT event_id, 'b' AS answer, CAST(json(props) AS VARCHAR) AS props FROM events")
def lenient_json(spark, d):
    e = table(spark, d, "events")
    said = F.concat(F.lit("<think>"), F.col("event_type"), F.lit("</think>```json\n{\"answer\": \"b\", \"props\": "), F.col("props"), F.lit("}\n```"))
    return e.select("event_id", parsing.field(said, "answer").alias("answer"), F.to_json(F.try_variant_get(F.try_parse_json(parsing.braces(parsing.body(said))), "$.props", "variant")).alias("props"))


@query("""WITH t AS (SELECT user_id, list_sort(list_distinct(list((epoch_us(ts) // 1000000 % 7200 // 60 * 60, epoch_us(ts) // 1000000 % 7200 // 60 * 60 + 30)))) AS r FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_transform(r, lambda x: printf('%d:%02d', x[1] // 60, x[1] % 60) || '-' || printf('%d:%02d', x[2] // 60, x[2] % 60)), ', ') AS covered FROM t""")
def covered_ranges(spark, d):
    m = F.floor(F.pmod(F.floor(seconds()), F.lit(7200)) / 60) * 60
    said = table(spark, d, "events").select("user_id", F.concat(F.lit("saw ["), m.cast("string"), F.lit("s-"), (m + 30).cast("string"), F.lit("s] it")).alias("t"))
    return said.groupBy("user_id").agg(F.collect_list("t").alias("t")).select("user_id", text.covered_ranges(F.col("t")).alias("covered"))


@query("""WITH t AS (SELECT doc_id, [CAST(doc_id % 5 AS INT), 2, CAST(doc_id % 3 AS INT), 9] AS o FROM documents), v AS (SELECT doc_id, list_filter(o, lambda i: i < 4) AS o FROM t),
u AS (SELECT doc_id, list_filter(o, lambda x, i: list_position(o, x) = i) AS o FROM v)
SELECT doc_id, array_to_string(list_concat(o, list_filter([0, 1, 2, 3], lambda i: NOT list_contains(o, i))), ',') AS permutation FROM u""")
def permutation_repair(spark, d):
    said = F.concat(F.lit("order: ["), (F.col("doc_id") % 5).cast("string"), F.lit(", 2, "), (F.col("doc_id") % 3).cast("string"), F.lit(", 9]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(parsing.permutation(parsing.integers(said), F.lit(4)).cast("array<string>"), ",").alias("permutation"))


@query("""WITH e AS (SELECT event_id, event_type, '[' || CAST(round_even(value, 0) AS BIGINT) || 's-' || CAST(round_even(value + 10, 0) AS BIGINT) || 's]' AS head, CASE WHEN event_id % 3 = 0 THEN '' ELSE ' said ' || event_type END AS asr FROM events)
SELECT event_id, event_type AS plain, trim(head || ' ' || event_type) || CASE WHEN trim(asr) <> '' THEN chr(10) || 'Speech: ' || asr ELSE '' END AS timed,
CASE WHEN trim(asr) <> '' THEN head || ' [DIALOGUE] "' || trim(asr) || '"' || chr(10) || event_type ELSE trim(head || ' ' || event_type) END AS dialogue,
head || chr(10) || event_type || chr(10) || 'Events: ' || event_type || ' | x' || CASE WHEN trim(asr) <> '' THEN chr(10) || 'Speech: ' || asr ELSE '' END AS layered FROM e""")
def evidence_text_layouts(spark, d):
    asr = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" said "), "event_type"))
    args = F.col("event_type"), asr, F.col("value"), F.col("value") + 10
    return table(spark, d, "events").select(
        "event_id", text.evidence_text(*args).alias("plain"), text.evidence_text(*args, with_time=True, with_asr=True).alias("timed"),
        text.evidence_text(*args, with_time=True, with_asr=True, dialogue_first=True).alias("dialogue"),
        text.evidence_text(*args, layers={"Events": F.array("event_type", F.lit("x")), "Actors": F.expr("cast(array() as array<string>)")}, with_time=True, with_asr=True).alias("layered"),
    )


@query("""SELECT p_partkey, '  (A) ' || p_name || chr(10) || '  (B) ' || p_brand || chr(10) || '  (C) ' || p_type AS lines, '(A) ' || p_name || ' (B) ' || p_brand || ' (C) ' || p_type AS inline,
[p_name, p_brand, p_type][1 + p_partkey % 3] AS chosen, p_name || '#chunk' || printf('%03d', p_partkey) || '@' || CAST(round_even(p_retailprice, 0) AS BIGINT) || '-' || CAST(round_even(p_retailprice + 0.5, 0) AS BIGINT) || 's' AS label FROM part""")
def option_formats(spark, d):
    c = F.array("p_name", "p_brand", "p_type")
    price = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", text.option_lines(c).alias("lines"), text.option_inline(c).alias("inline"), text.option_text(F.char(65 + F.col("p_partkey") % 3), c).alias("chosen"), text.chunk_label(F.col("p_name"), F.col("p_partkey"), price, price + 0.5).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CAST(least(60, 2 * pow(2, l_linenumber)) AS DOUBLE) AS wait_s, CAST(greatest(1, floor(w * least(1.0, 20.0 / greatest(w, h)))) AS INT) AS width, CAST(greatest(1, floor(h * least(1.0, 20.0 / greatest(w, h)))) AS INT) AS height
FROM (SELECT *, l_quantity AS w, CAST(1 + l_linenumber AS DOUBLE) AS h FROM lineitem)""")
def resize_and_backoff(spark, d):
    w, h = vector.fit_long_side(F.col("l_quantity"), (1 + F.col("l_linenumber")).cast("double"), 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", vector.backoff(F.col("l_linenumber")).alias("wait_s"), w.alias("width"), h.alias("height"))


@query("SELECT conv_id, '[E' || array_to_string(list_transform(t, lambda x, i: CAST(i AS VARCHAR) || '] ' || x), chr(10) || '[E') AS evidence FROM (SELECT conv_id, list(text ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1)")
def whole_numbered_evidence(spark, d):
    t = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s.text)
    return table(spark, d, "conversations").groupBy("conv_id").agg(t.alias("t")).select("conv_id", text.numbered(F.col("t")).alias("evidence"))


# --- plans --------------------------------------------------------------------------------------------------------


def documents_as_chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("memory_text"), providers.HashEmbedder()(F.col("text")).alias("v_dynamic"))


def benchmark_samples(spark, d):
    """Each benchmark text asks one source; its options are the texts of its group of four, its own is the gold one."""
    b = table(spark, d, "benchmark")
    group = b.groupBy(F.floor(F.col("item_id") / 4).alias("_g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda s: s.text).alias("candidates"))
    rows = b.withColumn("_g", F.floor(F.col("item_id") / 4)).join(group, "_g")
    return rows.select(F.col("item_id").alias("sample_key"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("video_id"), F.col("text").alias("question"), F.col("text").alias("query"), "candidates", F.char(65 + F.col("item_id") % 4).alias("gold"))


@query("""WITH words AS (SELECT 'd' AS side, doc_id AS id, source AS video, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM documents
  UNION ALL SELECT 'q', item_id, 'src' || (item_id % 20), unnest(string_split_regex(lower(text), '\\s+')) FROM benchmark),
n AS (SELECT side, id, video, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM words WHERE t <> '' GROUP BY ALL),
u AS (SELECT side, id, video, b, c / (sqrt(sum(c * c) OVER (PARTITION BY side, id)) + 1e-12) AS x FROM n),
s AS (SELECT q.id AS sample_key, d.id AS chunk_id, round(sum(q.x * d.x), 6) AS score FROM u q JOIN u d ON q.side = 'q' AND d.side = 'd' AND q.video = d.video AND q.b = d.b GROUP BY 1, 2)
SELECT sample_key, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8""")
def coarse_rag(spark, d):
    top = plans.coarse_rag(benchmark_samples(spark, d), documents_as_chunks(spark, d), providers.HashEmbedder())
    return top.withColumn("rank", F.col("rank").cast("bigint"))


from strandex.plans import answering  # noqa: E402, F401  it registers its queries here

from strandex.plans import framing  # noqa: E402, F401  and here
from strandex.plans import looping  # noqa: E402, F401  and here
