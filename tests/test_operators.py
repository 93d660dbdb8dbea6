"""Hand-made rows that pin edge semantics, and loop models beside the window plans."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandex.functions import parsing, text, vector
from strandex.operators import answers, dedup, joins, retrieval, sequence, verdict


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("r")).first().r


def frames(spark, vectors):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors)], "vid int, i int, v array<double>")


def loop_groups(vectors, theta, longest, least):
    groups = []
    for i, v in enumerate(vectors):
        if not groups or np.dot(v, vectors[i - 1]) < theta or len(groups[-1]) >= longest:
            groups.append([])
        groups[-1].append(i)
    out = []
    for g in groups:
        if out and len(g) < least:
            out[-1] += g
        else:
            out.append(list(g))
    return out


def chunked(spark, vectors, theta, longest, least):
    rows = sequence.fold_short(sequence.sessions(frames(spark, vectors), "vid", ["i"], "v", theta, longest), "vid", least).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.i):
        out.setdefault(r.chunk_idx, []).append(r.i)
    return list(out.values())


def test_short_groups_fold_left_but_the_first(spark):
    same = [[1.0, 0.0]] * 7
    assert [len(g) for g in chunked(spark, same, 0.5, 3, 3)] == [3, 4]
    first_short = [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    assert [len(g) for g in chunked(spark, first_short, 0.5, 9, 3)] == [1, 3]
    assert [len(g) for g in chunked(spark, [[1.0, 0.0], [0.0, 1.0]], 0.5, 9, 3)] == [2]


def test_sessions_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    for seed in range(3):
        v = rng.normal(size=(60, 4))
        v = (v / np.linalg.norm(v, axis=1)[:, None]).tolist()
        assert chunked(spark, v, 0.1, 4, 3) == loop_groups(v, 0.1, 4, 3)


def test_attributes(spark):
    rows = spark.createDataFrame([(1, 0, i, float(i)) for i in range(4)], "vid int, chunk_idx int, i int, ts double")
    r = sequence.attributes(rows, "vid", ["i"], "ts").first()
    assert (r.center, r.t_start, r.t_end, r.size) == (2, 0.0, 4.0, 4)


def test_failsafe_filter(spark):
    def left(bad):
        df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bad)], "g int, i int, b boolean")
        return sequence.unless_most(df, ["g"], F.col("b")).count()

    assert left([True, True, True, False, False]) == 5
    assert left([True, True, False, False]) == 2


def test_closed_and_open_overlap(spark):
    cue = spark.createDataFrame([(1, 5.0, 10.0)], "k int, start_s double, end_s double")
    win = spark.createDataFrame([(1, 10.0, 20.0)], "k int, t_start double, t_end double")
    assert joins.overlapping(cue, win, "k", 7).count() == 1
    assert joins.overlapping(cue, win, "k", 7, closed=False).count() == 0


def test_overlap_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    c = [(1, i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 100, 40), rng.integers(0, 30, 40), strict=True))]
    w = [(1, i, float(i * 10), float(i * 10 + 10)) for i in range(12)]
    got = {(r.c, r.w) for r in joins.overlapping(spark.createDataFrame(c, "k int, c int, start_s double, end_s double"), spark.createDataFrame(w, "k int, w int, t_start double, t_end double"), "k", 13).collect()}
    assert got == {(i, j) for _, i, a, b in c for _, j, s, e in w if b >= s and a <= e}


def test_cut_at_word(spark):
    long = " ".join(["nine char"[:9]] * 60)
    got = one(spark, text.cut_at_word(F.col("t"), 500), t=long)
    assert got == long[:500].rsplit(" ", 1)[0] + "…"
    assert one(spark, text.cut_at_word(F.col("t"), 4), t="abcdef") == "abcd…"
    assert one(spark, text.cut_at_word(F.col("t"), 6), t="abcdef") == "abcdef"


def test_greedy_keeps_rows_without_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [])], "g int, i int, v array<double>")
    for f in (dedup.greedy_similarity, dedup.dedup_large):
        assert sorted(r.i for r in f(rows, "g", "i", "v", 0.9).collect()) == [0, 2, 3]


def test_recent_hashes(spark):
    hashes = [0, 1, 0b11111, None, 0b111, *[(1 << 50 + k) | (0xFFFF << (3 * k)) for k in range(10)], 0]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(hashes)], "g int, i int, h bigint")

    def loop(most, window):
        kept, out = [], []
        for i, h in enumerate(hashes):
            if h is None:
                out.append(i)
            elif all(bin(h ^ k).count("1") > most for k in kept[-window:]):
                kept.append(h)
                out.append(i)
        return out

    for window in (2, 10):
        assert sorted(r.i for r in dedup.recent_hashes(rows, "g", "i", "h", 4, window).collect()) == loop(4, window)


def test_two_gates(spark):
    rows = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 255, [1.0, 0.0]), (1, 2, 1, [0.0, 1.0]), (1, 3, 1 << 40 | 0xFF00, [0.0, 1.0]), (1, 4, None, [0.5, 0.5])], "g int, i int, h bigint, v array<double>")
    assert sorted(r.i for r in dedup.two_gates(rows, "g", "i", "h", "v", 4, 0.95).collect()) == [0, 3]


def test_first_seen(spark):
    rows = spark.createDataFrame([("s", 0, 1, 1), ("s", 0, 2, 2), ("s", 1, 2, 1), ("s", 1, 3, 2)], "k string, q_pos int, chunk_id int, rank int")
    assert sorted((r.q_pos, r.chunk_id) for r in retrieval.first_seen(rows, ["k"]).collect()) == [(0, 1), (0, 2), (1, 3)]


def test_samples(spark):
    rows = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(r.id for r in sequence.stride_sample(rows, ["g"], ["id"], 4).collect()) == [0, 2, 4, 6]
    for n, k in ((5, 3), (7, 7), (100, 7), (13, 12), (29, 8)):
        got = sorted(r.id for r in sequence.even_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], k).collect())
        assert got == (list(range(n)) if n <= k else [int(i * (n / k)) for i in range(k)])


def test_position(spark):
    got = sequence.position(spark.range(1000).repartition(5), ["id"]).collect()
    assert sorted((r.id, r.sample_idx) for r in got) == [(i, i) for i in range(1000)]


def test_vectors(spark):
    assert abs(one(spark, vector.jaccard(vector.tokens(F.lit("a b a")), vector.tokens(F.lit("a c")))) - 1 / 3) < 1e-12
    assert one(spark, vector.jaccard(vector.tokens(F.lit("")), vector.tokens(F.lit("a")))) == 0.0
    assert one(spark, vector.hamming(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))) == 2
    assert one(spark, vector.hamming_text(F.lit("1010"), F.lit("1001"))) == 2
    assert one(spark, vector.max_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.array(F.lit(0.5), F.lit(9.0)), F.array(F.lit(-1.0), F.lit(0.0))))) == 0.5


def test_rubric_lines_and_verifier_prompt(spark):
    from strandex.functions import prompts

    kind = "criteria array<struct<name:string,description:string,score_1:string,score_half:string,score_0:string,weight:double>>, rule string, limit double"
    df = spark.createDataFrame([([("a", "da", "x", "y", "z", None), ("b", "db", "p", "q", "r", 2.0)], "average", 0.75)], kind)
    args = F.col("criteria"), F.col("rule"), F.col("limit")
    assert df.select(prompts.rubric_lines(*args).alias("r")).first().r == "  Criterion [a] : da (1=x; 0.5=y; 0=z)\n  Criterion [b]  [weight=2.0]: db (1=p; 0.5=q; 0=r)\n  Scoring: average of criteria; sufficient if score >= 0.75"
    assert df.select(prompts.rubric_lines(*args, long=True).alias("r")).first().r == "### Rubric Criteria  (scoring: average of scores; sufficient if score ≥ 0.75)\n  [a]   da\n    1.0 → x\n    0.5 → y\n    0.0 → z\n  [b]  [weight=2.0]  db\n    1.0 → p\n    0.5 → q\n    0.0 → r"
    p = one(spark, prompts.verifier_prompt(F.lit("q?"), F.array(F.lit("x")), F.expr("cast(array() as array<string>)"), F.lit("R")))
    assert p == "Question: q?\n\nOptions:\n  (A) x\n\nRubric:\nR\n\nEvidence, in order:\n(nothing found so far)\n\nGive the verdict as JSON."
    assert one(spark, prompts.repair_context(F.array(F.lit("c")), F.array(F.lit("A")), F.lit(" m "), by_rubric=False)) == "What is missing: m"
    assert set(prompts.VERIFIER) == {"strict", "loose", "plain", "attributed", "status"}


def test_half_way_values(spark):
    """Doubles whose spelling is half way: what they hold decides, as in DuckDB and in Python's rounding of the scaled value."""
    import duckdb

    for x, digits in [(0.58925, 4), (0.66475, 4), (0.12345, 4), (2.5, 0), (3.5, 0), (-0.5, 0), (1.005, 2), (2.675, 2), (0.25, 1), (0.35, 1)]:
        want = duckdb.connect().execute(f"SELECT round_even({x}::DOUBLE, {digits})").fetchone()[0]
        assert one(spark, vector.half_even(F.col("v"), digits), v=x) == want, (x, digits)
    assert one(spark, text.image_label(F.lit(2.5), F.lit(None).cast("int"))) == "[Frame at 2s]"


def test_times(spark):
    assert one(spark, text.hms(F.lit(2.5))) == "00:00:02"
    assert one(spark, text.hms(F.lit(3.5))) == "00:00:04"
    assert one(spark, text.srt_seconds(F.lit("01:02:03,250"))) == 3723.25
    assert one(spark, text.without_option_prefix(F.lit("A. cat"))) == "cat"
    assert one(spark, text.without_option_prefix(F.lit("AB"))) == "AB"


def verdict_of(spark, rows, threshold=0.8):
    options = spark.createDataFrame([("s", o, s, j) for o, s, j in rows], "k string, opt string, rubric_score double, said string")
    return verdict.verdicts(options.withColumn("judgment", verdict.enforced(F.col("rubric_score"), F.col("said"), threshold)), "k").first().label


def test_verdicts(spark):
    rest = [("C", 0.9, "false"), ("D", 0.9, "false")]
    assert verdict_of(spark, [("A", 0.9, "true"), ("B", 0.85, "false"), *rest]) == "FULLY_SUFFICIENT"
    assert verdict_of(spark, [("A", 0.9, "true"), ("B", 0.75, "false"), *rest]) == "INSUFFICIENT"
    assert verdict_of(spark, [("A", 0.9, "true"), ("B", 0.65, "false"), *rest]) == "ANSWER_SUFFICIENT"
    assert verdict_of(spark, [("A", 0.9, "true"), ("B", None, "false"), *rest]) == "ANSWER_SUFFICIENT"


def test_option_scores_and_weak_criteria(spark):
    cells = spark.createDataFrame([("s", "A", "x", 0.2, None), ("s", "A", "y", 0.6, -1.0), ("s", "A", "z", 0.4, 3.0)], "k string, opt string, criterion string, score double, weight double")
    assert abs(verdict.option_scores(cells, ["k", "opt"]).first().rubric_score - (0.2 + 1.2) / 4) < 1e-12
    options = spark.createDataFrame([("s", "A", "unknown")], "k string, opt string, judgment string")
    labels = spark.createDataFrame([("s", "INSUFFICIENT")], "k string, label string")
    got = verdict.weak_criteria(cells, options, labels, "k", "opt").orderBy("mean_score").collect()
    assert [(r.criterion, r.mean_score) for r in got] == [("x", 0.2), ("z", 0.4)]


def test_parsing(spark):
    letter = lambda t, n=4: one(spark, parsing.answer_letter(F.col("t"), F.lit(n)), t=t)
    assert letter('{"answer":"b"}') == "B"
    assert letter("I choose C.") == "C"
    assert letter("none") is None
    assert letter('```json\n{"answer": "E"}\n``` D', 4) == "D"
    assert one(spark, parsing.permutation(F.array(*map(F.lit, (2, 2, 9, 0))), F.lit(4))) == [2, 0, 1, 3]
    assert one(spark, parsing.criterion_scores(F.lit('{"a) x": {"c": "x", "d": "0.5"}}'))) == {"A": {"c": 0.0, "d": 0.5}}
    assert one(spark, parsing.judgments(F.lit('{"a": "TRUE", "b": "maybe"}'))) == {"A": "true"}
    assert one(spark, parsing.strings(F.lit('so: ["a ", "", "b"]'), F.lit("q"))) == ["a", "b"]
    assert one(spark, parsing.strings(F.lit("nothing"), F.lit("q"))) == ["q"]
    p = one(spark, parsing.plan(F.lit('{"strategy": "odd", "queries": []}'), F.lit("q")))
    assert (p.strategy, p.queries) == ("targeted", ["q"])
    assert one(spark, parsing.plan(F.lit("no json"), F.lit("q"))).reasoning == "parse_failed"
    assert one(spark, parsing.plan(F.lit('{"strategy": "Broadcast"}'), F.lit("q"))).queries == []
    assert one(spark, parsing.summary(F.lit('x ```json\n{"text": "t", "timeline": ["a"], "causality": []}\n```'))).timeline == ["a"]
    assert one(spark, parsing.summary(F.lit('{"text": "t"}'))).text == "[summary unavailable]"
    assert one(spark, parsing.rescued(F.lit('<think>x</think>{"answer": "C", "sufficient": yes'))).asDict() == {"answer": "C", "sufficient": True}


def test_texts(spark):
    assert one(spark, text.covered_ranges(F.array(F.lit("[65s-70s] x"), F.lit("[5s–9s] [65s-70s]")))) == "0:05-0:09, 1:05-1:10"
    assert one(spark, text.numbered(F.expr("cast(array() as array<string>)"))) == "(none)"
    assert one(spark, text.image_label(F.lit(3.0), F.lit(2))) == "[Frame at 3s — Segment 2]"
    assert one(spark, text.chunk_label(F.lit("v"), F.lit(7), F.lit(0.5), F.lit(1.5))) == "v#chunk007@0-2s"
    assert one(spark, text.without_thinking(F.lit("a</think> b"))) == "b"
    assert one(spark, text.frame_name(F.lit(3), F.lit(4))) == "c00003_f04.jpg"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=12))
def test_greedy_is_maximal(spark, points):
    v = [[float(a), float(b)] for a, b in points]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "g int, i int, v array<double>")
    kept = sorted(r.i for r in dedup.greedy_similarity(rows, "g", "i", "v", 0.5).collect())
    near = lambda a, b: round(sum(x * y for x, y in zip(v[a], v[b], strict=True)), 6) >= 0.5
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(i in kept or any(near(k, i) for k in kept if k < i) for i in range(len(v)))


def test_position_at_size(spark):
    """More and wider rows than the range partitioner samples, in no order."""
    n = 600_000
    rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 7).cast("int")).alias("wide")).repartition(5)
    got = sequence.position(rows, ["k"])
    assert got.where("sample_idx <> k").count() == 0 and got.count() == n
    assert sequence.position(rows.limit(0), ["k"]).count() == 0


def test_dedup_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = []
    for x in v:
        if not kept or (np.round(np.stack(kept) @ x, 6) < 0.8).all():
            kept.append(x)
    for block in (1, 64, 2000):
        keep = dedup.first_of_kind(v, 0.8, block)
        assert (v[keep] == np.stack(kept)).all()
    rows = [(0, i, x.tolist()) for i, x in enumerate(v)] + [(1, 5, None), (1, 6, []), (1, 7, v[0].tolist()), (1, 8, v[0].tolist()), (2, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    got = sorted(map(tuple, dedup.dedup_large(df, "k", "i", "v", 0.8).collect()))
    assert got == sorted([(0, int(i)) for i in np.flatnonzero(dedup.first_of_kind(v, 0.8))] + [(1, 5), (1, 6), (1, 7), (2, 0)])


def test_recent_hashes_window(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 64)) if i % 9 else None) for i in range(300)]
    got = sorted(map(tuple, dedup.recent_hashes(spark.createDataFrame(rows, "k int, i int, h bigint"), "k", "i", "h", 1, 4).collect()))
    want, last = [], {}
    for k, i, h in rows:
        if h is None:
            want.append((k, i))
        elif all(bin(h ^ x).count("1") > 1 for x in last.get(k, [])[-4:]):
            want.append((k, i))
            last.setdefault(k, []).append(h)
    assert got == sorted(want)


def test_rubric(tmp_path):
    from strandex.plans.rubric import Rubric

    data = {"general": {"rubric_criteria": [{"name": "g"}], "sufficient_threshold": 0.7}, "templates": {"t": {"rubric_criteria": [{"name": "x"}], "scoring_rule": "minimum"}, "u": {}}, "type_aliases": {"Kind": "t"}, "keyword_rules": [{"keywords": "why", "qtype": "u"}]}
    (tmp_path / "r.json").write_text(json.dumps(data))
    r = Rubric.read(str(tmp_path / "r.json"))
    assert (r.combined("t"), r.combined("u"), r.combined("")) == ((["g", "x"], "minimum", 0.7), (["g"], "average", 0.7), (["g"], "average", 0.7))
    with pytest.raises(ValueError, match="general"):
        Rubric.of({"templates": {}})


def test_answers_without_evidence(spark):
    key = spark.createDataFrame([(1, [], "[3]"), (2, [3, 4], "none"), (3, [3, 4], "take [4, 9]"), (4, [3], "[]")], "k int, ids array<bigint>, said string")
    frames = spark.createDataFrame([(k, c) for k in (1, 2, 3, 4) for c in (3, 4)], "k int, chunk_id bigint")
    got = sorted((r.k, r.chunk_id, r.status) for r in answers.gated(frames, key, "k").collect())
    assert got == [(2, 3, "fail"), (2, 4, "fail"), (3, 4, "ok")]
    said = spark.createDataFrame([("{\"selected\": [5, 1, 0, 1]}", 3), ("{\"selected\": []}", 2), ("{broken", 5), (None, 0)], "s string, n int")
    got = [[(p.idx, p.score) for p in r.p] for r in said.select(answers.selected(F.col("s"), F.col("n"), 2).alias("p")).collect()]
    assert got == [[(1, 1.0), (0, 0.99)], [(0, 1.0), (1, 1.0)], [(0, 1.0), (1, 1.0)], []]
