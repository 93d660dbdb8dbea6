"""The loop's registered queries beside their SQL, which unrolls the rounds: queries, filters, greedy folds, verdicts and what leaves, round by round."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.plans import providers
from strandex.plans import retrieval as plans
from strandex.plans.rubric import Rubric
from strandex.plans.catalog import benchmark_samples, query
from strandex.scratch import small_batches, written
from strandex.session import table

#: Limits that the stand-in judge reaches at times.
RUBRIC = Rubric.of({
    "general": {"rubric_criteria": [{"name": "coverage"}], "sufficient_threshold": 0.4},
    "templates": {"causal": {"rubric_criteria": [{"name": "cause"}], "sufficient_threshold": 0.44}},
    "keyword_rules": [{"keywords": ["thing", "these"], "qtype": "causal"}],
})

#: Everything wired: thresholds by the question's rubric, pruning, order of use, frames on request.
WHOLE = plans.Loop(margin=0.06, evidence_similarity=0.85, query_similarity=0.5, query_drift=0.8, visual_similarity=0.8, images_a_chunk=2, most_keyframes=10, most_evidence=24, prune=True, rerank=True, answer_evidence=20, text_first=True)
REPEATED = plans.Loop(threshold=0.42, margin=0.04, evidence_similarity=0.85, visual_similarity=0.8, images_a_chunk=2, single_query=True, ignore_verifier=True, repeat_queries=True)


def tokens_of(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda t: t <> '')"


def vector_of(tokens: str) -> str:
    """The stand-in embedder: counts of tokens by hash, scaled to unit length."""
    places = f"list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
    counts = f"list_transform([{places}], lambda p: list_transform(range(64), lambda b: len(list_filter(p, lambda y: y = b))::DOUBLE))[1]"
    return f"list_transform([{counts}], lambda c: list_transform(c, lambda y: y / (sqrt(list_sum(list_transform(c, lambda z: z * z))) + 1e-12)))[1]"


def near(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}), 6)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


def fold(name: str, rows: str, vector: str, threshold: float, start: str = "[]", joins: str = "TRUE") -> str:
    """ids of rows (k, rn from 1, id) kept in order below the threshold to all that joined before; start: a list of vectors by k to begin with."""
    step = f"len(list_filter(f.kept, lambda k: {near('k', 'o.' + vector)} >= {threshold})) > 0"
    return f"""{name}_f AS (SELECT k, 0::BIGINT AS rn, []::BIGINT[] AS ids, {start}::DOUBLE[][] AS kept FROM (SELECT DISTINCT k FROM {rows}) s
  UNION ALL SELECT f.k, o.rn, CASE WHEN near THEN f.ids ELSE list_append(f.ids, o.rn) END, CASE WHEN near OR NOT ({joins}) OR o.{vector} IS NULL THEN f.kept ELSE list_append(f.kept, o.{vector}) END
  FROM {name}_f f JOIN {rows} o ON o.k = f.k AND o.rn = f.rn + 1, LATERAL (SELECT coalesce({step}, FALSE) AS near)),
{name} AS (SELECT r.* FROM {rows} r JOIN (SELECT k, unnest(ids) AS rn FROM (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn DESC) = 1)) USING (k, rn))"""


def loop_sql(how: plans.Loop) -> str:
    """Common tables up to `answers` and `trace`."""
    c = [
        f"d AS (SELECT doc_id AS id, source AS video, text, n_chars, {tokens_of('text')} AS w FROM documents)",
        f"ch AS (SELECT id, video, list_distinct(w) AS tk, {vector_of('w')} AS v, {vector_of('list_filter(w, lambda t, i: i % 2 = 0)')} AS vis, n_chars FROM d)",
        f"img AS (SELECT id, id || '/' || u AS image FROM ch, (SELECT unnest([0, 1, 2]) AS u) WHERE (n_chars + u) % 3 > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY id || '/' || u) <= {how.images_a_chunk})",
        "b AS (SELECT item_id AS k, 'src' || item_id % 20 AS video, text AS question, chr((65 + item_id % 4)::INT) AS gold, item_id // 4 AS g FROM benchmark)",
        "cand AS (SELECT b.k, chr((65 + c.k % 4)::INT) AS opt, c.question AS candidate, CAST(c.k % 4 AS INT) AS place, list_distinct(" + tokens_of("c.question") + ") AS tk FROM b JOIN b c USING (g))",
        "lim AS (SELECT k, %s AS threshold FROM b)" % ("CASE WHEN lower(question) LIKE '%thing%' OR lower(question) LIKE '%these%' THEN 0.44 ELSE 0.4 END" if how is WHOLE else f"{how.threshold}"),
        "live0 AS (SELECT k, video, question, gold FROM b)",
    ]
    c.append("aq0 AS (SELECT k, video, 0 AS q_pos, question AS query FROM live0" + ("" if how.single_query else " UNION ALL SELECT k, video, place + 1, question || ' Evidence for (' || opt || ') ' || candidate FROM live0 JOIN cand USING (k)") + ")")
    for i in range(how.max_rounds):
        p = i - 1
        if i and how.ignore_verifier:
            c.append(f"aq{i} AS (SELECT k, video, 0 AS q_pos, question AS query FROM live{i})")
        elif i:
            c.append(f"op{i} AS (SELECT k, opt, candidate FROM judged{p} JOIN cand USING (k, opt) WHERE judgment = 'unknown')")
            c.append(f"aq{i} AS (SELECT k, video, CAST(row_number() OVER (PARTITION BY k ORDER BY opt, candidate) - 1 AS INT) AS q_pos, 'Evidence for (' || opt || ') ' || candidate AS query FROM live{i} JOIN op{i} USING (k) UNION ALL SELECT k, video, 0, question FROM live{i} WHERE k NOT IN (SELECT k FROM op{i}))")
        c.append(f"av{i} AS (SELECT *, list_distinct(w) AS tk, {vector_of('w')} AS v FROM (SELECT *, {tokens_of('query')} AS w FROM aq{i}))")
        if i and not how.repeat_queries:
            c.append(f"""jq{i} AS (SELECT k, q_pos, coalesce((SELECT max(round({jaccard('a.tk', 'h.tk')}, 6)) FROM hist{p} h WHERE h.k = a.k) < {how.query_similarity}, TRUE) AND coalesce((SELECT max({near('a.v', 'e.v')}) FROM ev{p} e WHERE e.k = a.k) < {how.query_drift}, TRUE) AS kept FROM av{i} a)""")
            c.append(f"st{i} AS (SELECT k, CASE WHEN bool_or(kept) THEN 'targeted' ELSE 'broadcast' END AS strategy FROM jq{i} GROUP BY 1)")
            c.append(f"as{i} AS (SELECT a.* FROM av{i} a JOIN jq{i} USING (k, q_pos) WHERE kept)")
        else:
            c.append(f"st{i} AS (SELECT k, 'targeted' AS strategy FROM live{i})")
            c.append(f"as{i} AS (SELECT * FROM av{i})")
        c.append(f"hist{i} AS (SELECT k, tk FROM as{i} UNION ALL SELECT k, tk FROM hist{p})" if i else f"hist0 AS (SELECT k, tk FROM as0 UNION ALL SELECT k, list_distinct({tokens_of('question')}) FROM b)")
        c.append(f"top{i} AS (SELECT k, q_pos, ch.id, row_number() OVER (PARTITION BY k, q_pos ORDER BY {near('a.v', 'ch.v')} DESC, ch.id) AS rank FROM as{i} a JOIN ch USING (video) QUALIFY rank <= {how.top_k})")
        found = f"SELECT k, q_pos, id, rank FROM top{i}"
        if i:
            found += f" WHERE (k, id) NOT IN (SELECT (k, id) FROM seen{p})"
            if not how.repeat_queries:
                c.append(f"idle{i} AS (SELECT l.k, ch.id, row_number() OVER (PARTITION BY l.k ORDER BY ch.id) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY l.k) // {how.top_k}) AS step FROM live{i} l JOIN st{i} s ON s.k = l.k AND strategy = 'broadcast' JOIN ch USING (video) WHERE (l.k, ch.id) NOT IN (SELECT (k, id) FROM seen{p}))")
                found += f" UNION ALL SELECT k, 0, id, row_number() OVER (PARTITION BY k ORDER BY id) FROM idle{i} WHERE rn % step = 0 AND rn // step < {how.top_k}"
        c.append(f"new{i} AS (SELECT k, id, {i} AS r, q_pos, rank FROM ({found}) QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY q_pos, rank) = 1)")
        old = f"SELECT k, id, r, q_pos, rank FROM ev{p} WHERE k IN (SELECT k FROM live{i}) UNION ALL " if i else ""
        c.append(f"pool{i} AS (SELECT n.*, v, tk, vis, row_number() OVER (PARTITION BY k ORDER BY r, q_pos, rank) AS rn FROM ({old}SELECT k, id, r, q_pos, rank FROM new{i}) n JOIN ch USING (id))")
        c.append(fold(f"kept{i}", f"pool{i}", "v", how.evidence_similarity))
        c.append(f"evid{i} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY rn) AS rn) FROM kept{i} QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn) <= {how.most_evidence})")
        c.append(f"seen{i} AS (SELECT k, id FROM pool{i}" + (f" UNION SELECT k, id FROM seen{p}" if i else "") + ")")
        c.append(f"late{i} AS (SELECT k, id, vis, r, q_pos, rank, id IN (SELECT id FROM img) AS loads, row_number() OVER (PARTITION BY k ORDER BY rn) AS rn FROM evid{i} WHERE r = {i})")
        start = f"coalesce((SELECT list(vis) FROM (SELECT DISTINCT f.k, f.id, vis FROM frames{p} f JOIN ch USING (id)) x WHERE x.k = s.k), [])" if i else "[]"
        c.append(fold(f"vis{i}", f"late{i}", "vis", how.visual_similarity, start, "o.loads"))
        old = f"SELECT * FROM frames{p} WHERE k IN (SELECT k FROM live{i}) UNION ALL " if i else ""
        c.append(f"fr{i} AS ({old}SELECT k, r, q_pos, rank, id, image FROM vis{i} JOIN img USING (id))")
        c.append(f"words{i} AS (SELECT k, list_distinct(flatten(list(tk))) AS pool FROM evid{i} GROUP BY 1)")
        c.append(f"score{i} AS (SELECT k, opt, round(CASE WHEN len(tk) > 0 THEN len(list_intersect(tk, coalesce(pool, []))) / len(tk) ELSE 0 END, 9) AS score FROM live{i} JOIN cand USING (k) LEFT JOIN words{i} USING (k))")
        c.append(f"judged{i} AS (SELECT k, opt, score, said, CASE WHEN score < threshold THEN 'unknown' ELSE said END AS judgment FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY score DESC, opt) = 1 THEN 'true' ELSE 'false' END AS said FROM score{i}) JOIN lim USING (k))")
        c.append(f"""sum{i} AS (SELECT k, count(*) FILTER (judgment = 'true') AS t, count(*) FILTER (judgment = 'unknown') AS u, max(score) FILTER (judgment = 'true') AS ts, max(score) FILTER (judgment = 'unknown') AS us, max(opt) FILTER (said = 'true') AS answer FROM judged{i} GROUP BY 1)""")
        c.append(f"lab{i} AS (SELECT k, answer, CASE WHEN t = 1 AND u = 0 THEN 'FULLY_SUFFICIENT' WHEN t = 1 AND round(ts - us, 9) >= {how.margin} THEN 'ANSWER_SUFFICIENT' ELSE 'INSUFFICIENT' END AS label FROM sum{i})")
        if how.prune:
            c.append(f"asks{i} AS (SELECT k, list_distinct(flatten(list(tk))) AS asked FROM cand GROUP BY 1)")
            c.append(f"ev{i} AS (SELECT e.* FROM evid{i} e JOIN asks{i} USING (k) WHERE len(list_intersect(tk, asked)) > 0)")
            c.append(f"frames{i} AS (SELECT * FROM fr{i} WHERE (k, id) IN (SELECT (k, id) FROM ev{i}))")
        else:
            c.append(f"ev{i} AS (SELECT * FROM evid{i})")
            c.append(f"frames{i} AS (SELECT * FROM fr{i})")
        c.append(f"trace{i} AS (SELECT l.k, {i} AS round, answer, label, coalesce(strategy, 'broadcast') AS strategy, (SELECT count(*) FROM ev{i} e WHERE e.k = l.k) AS n_evidence, least({how.most_keyframes}, (SELECT count(*) FROM frames{i} f WHERE f.k = l.k)) AS n_keyframes FROM lab{i} l LEFT JOIN st{i} USING (k))")
        c.append(f"over{i} AS (SELECT * FROM trace{i}" + ("" if i == how.max_rounds - 1 else " WHERE label <> 'INSUFFICIENT'") + ")")
        c.append(f"live{i + 1} AS (SELECT * FROM live{i} WHERE k NOT IN (SELECT k FROM over{i}))")
    every = lambda name, columns: " UNION ALL ".join(f"SELECT {columns} FROM {name}{i} WHERE k IN (SELECT k FROM over{i})" for i in range(how.max_rounds))
    order = f"len(list_intersect(e.tk, list_distinct({tokens_of('question')}))) DESC, r, q_pos, rank" if how.rerank else "r, q_pos, rank"
    cap = "" if how.answer_evidence is None else f" WHERE place <= {how.answer_evidence}"
    c.append(f"used AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY k ORDER BY {order}) AS place FROM ({every('ev', 'k, id, r, q_pos, rank, tk')}) e JOIN b USING (k)){cap})")
    c.append("final AS (" + " UNION ALL ".join(f"SELECT * FROM over{i}" for i in range(how.max_rounds)) + ")")
    c.append(f"seenf AS (SELECT f.*, row_number() OVER (PARTITION BY f.k ORDER BY u.place NULLS LAST, f.r, f.q_pos, f.rank, image) AS n FROM ({every('frames', '*')}) f LEFT JOIN used u ON u.k = f.k AND u.id = f.id)")
    if how.text_first:
        c.append("need AS (SELECT u.k, u.id FROM used u JOIN final f ON f.k = u.k JOIN cand c ON c.k = u.k AND c.opt = f.answer WHERE 2 * len(list_intersect(u.tk, c.tk)) < len(c.tk))")
        c.append("gate AS (SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY n) AS n) FROM seenf WHERE (k, id) IN (SELECT (k, id) FROM need))")
    else:
        c.append("gate AS (SELECT * FROM seenf)")
    c.append(f"""answers AS (SELECT k AS sample_key, answer, label, round + 1 AS rounds, n_evidence, n_keyframes, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY place) FROM used u WHERE u.k = f.k), '') AS evidence,
  coalesce((SELECT string_agg(image, ',' ORDER BY n) FROM gate g WHERE g.k = f.k AND n <= {how.most_keyframes}), '') AS keyframes FROM final f)""")
    c.append("trace AS (" + " UNION ALL ".join(f"SELECT * FROM trace{i}" for i in range(how.max_rounds)) + ")")
    return "WITH RECURSIVE " + ",\n".join(c)


def inputs(spark, d):
    """(chunks, images): documents are the chunks of their source. Every other token of a text makes its visual vector, and two of three places of a chunk
    hold an image that loads."""
    small_batches(spark)
    docs = table(spark, d, "documents")
    embed = providers.HashEmbedder()
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    odd = F.array_join(F.filter(words, lambda t, i: i % 2 == 1), " ")
    chunks = docs.select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("memory_text"), embed(F.col("text")).alias("v_dynamic"), embed(odd).alias("v_visual"))
    images = docs.select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), "n_chars", F.explode(F.array(*map(F.lit, range(3)))).alias("u")).where((F.col("n_chars") + F.col("u")) % 3 > 0)
    return written(chunks, "chunks"), images.select("video_id", "chunk_id", F.concat_ws("/", "chunk_id", "u").alias("image"))


def shown(name):
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


def run(spark, d, how):
    chunks, images = inputs(spark, d)
    samples = benchmark_samples(spark, d)
    if how is WHOLE:
        routed = RUBRIC.applied(samples.withColumn("_type", F.lit("")), "question", "_type")
        samples = written(routed.select(*samples.columns, "threshold"), "samples")
    answers, trace = plans.run_loop(samples, chunks, providers.HashEmbedder(), how, images=images)
    return answers.select("sample_key", "answer", "label", "rounds", "n_evidence", "n_keyframes", shown("evidence"), shown("keyframes")), trace


@query(loop_sql(WHOLE) + " SELECT * FROM answers")
def iterative_loop(spark, d):
    return run(spark, d, WHOLE)[0]


@query(loop_sql(WHOLE) + " SELECT k AS sample_key, round, answer, label, strategy, n_evidence, n_keyframes FROM trace")
def iterative_loop_trace(spark, d):
    return run(spark, d, WHOLE)[1].select("sample_key", "round", "answer", "label", "strategy", "n_evidence", "n_keyframes")


@query(loop_sql(REPEATED) + " SELECT * FROM answers")
def repeated_question_loop(spark, d):
    return run(spark, d, REPEATED)[0]


COARSE = plans.Loop(most_keyframes=6, visual_similarity=0.85, images_a_chunk=2, rerank=True, answer_evidence=6)


@query(
    "WITH RECURSIVE "
    + ",\n".join([
        *loop_sql(COARSE).removeprefix("WITH RECURSIVE ").split(",\n")[:3],
        "b AS (SELECT item_id AS k, 'src' || item_id % 23 AS video, text AS question, item_id // 4 AS g FROM benchmark)",
        f"cand AS (SELECT b.k, chr((65 + c.k % 4)::INT) AS opt, c.question AS candidate, list_distinct({tokens_of('c.question')}) AS tk FROM b JOIN b c USING (g))",
        f"q AS (SELECT *, {vector_of('w')} AS v FROM (SELECT k, video, {tokens_of("question || chr(10) || 'Choices:' || chr(10) || opts")} AS w FROM b JOIN (SELECT k, string_agg('  (' || opt || ') ' || candidate, chr(10) ORDER BY opt) AS opts FROM cand GROUP BY 1) USING (k)))",
        f"found AS (SELECT q.k, ch.id, ch.tk, ch.vis, row_number() OVER (PARTITION BY q.k ORDER BY {near('q.v', 'ch.v')} DESC, ch.id) AS rn FROM q JOIN ch USING (video) QUALIFY rn <= 8)",
        "late AS (SELECT *, id IN (SELECT id FROM img) AS loads FROM found)",
        fold("vis", "late", "vis", COARSE.visual_similarity, "[]", "o.loads"),
        "words AS (SELECT k, list_distinct(flatten(list(tk))) AS pool FROM found GROUP BY 1)",
        "score AS (SELECT k, opt, round(CASE WHEN len(tk) > 0 THEN len(list_intersect(tk, coalesce(pool, []))) / len(tk) ELSE 0 END, 9) AS score FROM cand LEFT JOIN words USING (k))",
        "said AS (SELECT k, arg_max(opt, (score, -ascii(opt))) AS answer FROM score GROUP BY 1)",
        f"used AS (SELECT * FROM (SELECT f.k, f.id, row_number() OVER (PARTITION BY f.k ORDER BY len(list_intersect(f.tk, list_distinct({tokens_of('b.question')}))) DESC, rn) AS place FROM found f JOIN b USING (k)) WHERE place <= {COARSE.answer_evidence})",
        "seen AS (SELECT v.k, image, row_number() OVER (PARTITION BY v.k ORDER BY u.place NULLS LAST, v.rn, image) AS n FROM vis v JOIN img USING (id) LEFT JOIN used u ON u.k = v.k AND u.id = v.id)",
    ])
    + f""" SELECT k AS sample_key, answer, (SELECT count(*) FROM found f WHERE f.k = s.k) AS n_evidence, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY place) FROM used u WHERE u.k = s.k), '') AS evidence,
    coalesce((SELECT string_agg(image, ',' ORDER BY n) FROM seen x WHERE x.k = s.k AND n <= {COARSE.most_keyframes}), '') AS keyframes FROM said s"""
)
def coarse_rag_answers(spark, d):
    """One search with the options in the query; every eighth question or so asks a video that isn't there."""
    chunks, images = inputs(spark, d)
    samples = benchmark_samples(spark, d).withColumn("video_id", F.concat(F.lit("src"), (F.col("sample_key") % 23).cast("string")))
    got = plans.coarse_answers(written(samples, "samples"), chunks, providers.HashEmbedder(), 8, COARSE, images=images)
    return got.select("sample_key", "answer", "n_evidence", shown("evidence"), shown("keyframes"))
