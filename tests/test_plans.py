"""The retrieval plans, the loop's ablations, providers and streams."""

import numpy as np
from pyspark.sql import functions as F

from strandex.plans import catalog, providers, retrieval
from strandex.plans.retrieval import Loop
from strandex.streaming import streams


def tables(spark):
    samples = spark.createDataFrame([(1, "v", "what animal", "what animal", ["red cat", "blue dog"], "A"), (2, "none", "x", "x", ["p", "q"], "B")], "sample_key int, video_id string, question string, query string, candidates array<string>, gold string")
    chunks = spark.createDataFrame([("v", i, t, float(i)) for i, t in enumerate(["a red cat sat", "a red cat sat", "green tree", "the animal ran", "blue sky"])], "video_id string, chunk_id bigint, memory_text string, start_time double")
    return samples, chunks.withColumn("v_dynamic", providers.HashEmbedder()(F.col("memory_text")))


def test_coarse_and_rerank(spark):
    samples, chunks = tables(spark)
    e = providers.HashEmbedder()
    top = retrieval.coarse_rag(samples, chunks, e, 2).collect()
    assert {r.sample_key for r in top} == {1} and top[0].chunk_id == 3
    fused = retrieval.coarse_rag(samples, chunks.withColumn("v_visual", F.when(F.col("chunk_id") == 4, e(F.lit("what animal")))), e, 1, visual=e).first()
    assert fused.chunk_id in (3, 4)
    score = providers.ModelScorer(lambda: lambda pairs: [len(p) for _, p in pairs])
    got = retrieval.rerank_rag(samples, chunks, e, score, 5, 2).orderBy("rank").collect()
    assert [r.rerank_score for r in got] == [14.0, 13.0]


def test_timeline_and_context(spark):
    samples, chunks = tables(spark)
    seen = spark.createDataFrame([(1, 0)], "sample_key int, chunk_id bigint")
    assert sorted(r.chunk_id for r in retrieval.timeline(samples, chunks, seen, 2).collect()) == [1, 3]
    assert retrieval.best_context(samples, chunks, providers.HashEmbedder(), 1).first().context == "the animal ran"


def test_loop(spark):
    samples, chunks = tables(spark)
    e = providers.HashEmbedder()
    answers, trace = retrieval.run_loop(samples, chunks, e, Loop(top_k=2))
    got = {r.sample_key: r for r in answers.collect()}
    assert got[1].answer == "A" and got[1].label == "ANSWER_SUFFICIENT" and got[1].rounds == 1
    assert got[2].rounds == 3 and got[2].n_evidence == 0 and trace.count() == 4
    for how in (Loop(oracle=True), Loop(judge_by_rubric=False), Loop(ignore_verifier=True, max_rounds=2)):
        assert retrieval.run_loop(samples, chunks, e, how)[0].count() == 2
    assert retrieval.repeated_question(samples, chunks, e, Loop(max_rounds=2))[0].count() == 2


def test_loop_filters_and_broadcast(spark):
    """Queries that were asked before are dropped, and a question that is left without any gets chunks spread over its video."""
    samples, chunks = tables(spark)
    samples = samples.where("sample_key = 1").withColumn("candidates", F.array(F.lit("zebra"), F.lit("yak"))).withColumn("gold", F.lit("B"))
    seen = chunks.withColumn("v_visual", F.col("v_dynamic"))
    again = lambda live, _: live.select("sample_key", "video_id", F.lit(0).alias("q_pos"), F.col("question").alias("query"))
    answers, trace = retrieval.run_loop(samples, seen, providers.HashEmbedder(), Loop(top_k=1, max_rounds=3, single_query=True, oracle=True), retrieval.Providers(plan=again))
    rows = {r["round"]: r for r in trace.collect()}
    assert [rows[i].strategy for i in range(3)] == ["targeted", "broadcast", "broadcast"]
    assert rows[0].n_evidence == 1 and rows[2].n_evidence > rows[0].n_evidence and rows[2].n_keyframes == rows[2].n_evidence
    assert rows[0].label == "INSUFFICIENT" and answers.first().rounds == 3
    met = retrieval.run_loop(samples.withColumn("gold", F.lit("A")), seen, providers.HashEmbedder(), Loop(top_k=1, oracle=True))[0].first()
    assert (met.label, met.rounds) == ("FULLY_SUFFICIENT", 1)


def test_providers(spark):
    texts = spark.createDataFrame([("a b",), ("c",)], "t string")
    v = texts.select(providers.ModelEmbedder(lambda: lambda xs: np.array([[len(x), 1.0] for x in xs]))(F.col("t")).alias("v")).collect()
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in v)
    calls = []

    def load():
        def f(prompts):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("busy")
            return [p.upper() for p in prompts]

        return f

    assert sorted(r.answer for r in providers.Chat(load, base_s=0.01)(texts, "t").collect()) == ["A B", "C"]


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 3)).tolist()
    rows = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(v)], "k int, i int, v array<double>").withColumn("ts", F.timestamp_seconds(F.col("i") + 1_700_000_000)).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.sessions(streams.parquet_stream(spark, str(tmp_path / "in"), rows.schema), "k", "i", "v", 0.1, 4, "ts").drop("opened")
    q = out.writeStream.format("memory").queryName("sessions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    from strandex.operators import sequence

    want = sequence.sessions(rows, "k", ["i"], "v", 0.1, 4).select("k", "i", F.col("raw_group").cast("bigint")).collect()
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, want))
    done = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, x int")
    done.write.parquet(str(tmp_path / "r"))
    for n in range(2):
        streams.append_new(streams.parquet_stream(spark, str(tmp_path / "r"), done.schema), str(tmp_path / "out"), "key", str(tmp_path / f"c2{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    ev = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:00:09",), ("2024-01-01 00:00:11",)], "s string").select(F.to_timestamp("s").alias("ts"), F.lit("u").alias("u"))
    ev.write.parquet(str(tmp_path / "ev"))
    q = streams.tumbling_counts(streams.parquet_stream(spark, str(tmp_path / "ev"), ev.schema, 9), "ts", "10 seconds", "1 minute", ["u"]).writeStream.outputMode("update").format("memory").queryName("tumbling").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("tumbling").collect()) == [1, 2]


def test_session_state_ends(spark, tmp_path):
    """A key's state goes once the watermark has passed its last frame; late frames and frames out of order are left out, and a key that returns begins anew."""
    start = 1_700_000_000
    batches = [[("a", 0, 0, 1.0), ("a", 1, 1, 1.0), ("b", 0, 2, 1.0)], [("a", 1, 3, 1.0), ("a", 2, 4, 0.0), ("b", 1, 500, 1.0)], [("a", 9, 100, 1.0), ("b", 2, 501, 1.0)], [("a", 5, 502, 1.0), ("b", 3, 3000, 1.0)], [("c", 0, 6000, 1.0)], [("c", 1, 6001, 1.0)]]
    kind = "k string, i int, ts timestamp, v array<double>"
    check = str(tmp_path / "check")
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, i, s, [x, 1 - x]) for k, i, s, x in rows], "k string, i int, s bigint, v array<double>").select("k", "i", F.timestamp_seconds(F.col("s") + start).alias("ts"), "v")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.sessions(streams.parquet_stream(spark, str(tmp_path / "in"), kind), "k", "i", "v", 0.5, 9, "ts", "10 seconds", 100_000)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        if n == 1:
            held = spark.read.format("statestore").option("stateVarName", "held").load(check)
            assert {r.key.k for r in held.collect()} >= {"b"}
    got = sorted((r.k, r.i, r.raw_group, int(r.opened.timestamp()) - start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # a/1 came twice; a/9 came at 100 when the watermark stood at 490; a returned at 502, after its state had gone; each frame of b came before its timer
    assert got == [("a", 0, 0, 0), ("a", 1, 0, 0), ("a", 2, 1, 0), ("a", 5, 0, 502), ("b", 0, 0, 2), ("b", 1, 0, 2), ("b", 2, 0, 2), ("b", 3, 0, 2), ("c", 0, 0, 6000), ("c", 1, 0, 6000)]
    held = spark.read.format("statestore").option("stateVarName", "held").load(check)
    assert {r.key.k for r in held.collect()} == {"c"}


def test_append_costs_what_a_batch_holds(spark, tmp_path):
    """Batches don't read what was written before, a key goes once, and a batch that is run again adds nothing."""
    check, out, kind = str(tmp_path / "c"), str(tmp_path / "out"), "key string, x int, ts timestamp"
    for n in range(3):
        rows = [(f"k{i}", n, 1_700_000_000 + n) for i in range(n, n + 5)]
        spark.createDataFrame(rows, "key string, x int, s bigint").select("key", "x", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.append_new(streams.parquet_stream(spark, str(tmp_path / "in"), kind), out, "key", check, "ts", "1 hour")
        q.awaitTermination()
        assert sum(s["numInputRows"] for p in q.recentProgress for s in p["sources"]) == 5 and str(tmp_path / "out") not in str([p["sources"] for p in q.recentProgress])
    streams.append_new(streams.parquet_stream(spark, str(tmp_path / "in"), kind), out, "key", str(tmp_path / "again"), "ts", "1 hour").awaitTermination()
    assert sorted((r.key, r.x) for r in spark.read.parquet(out).collect()) == sorted([(f"k{i}", max(0, i - 4)) for i in range(7)])


def test_whole_numbered_evidence(spark, tmp_path):
    long = "word " * 100 + "end"
    spark.createDataFrame([(1, 1, "assistant", "b" * 30), (1, 0, "user", long)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.evidence for r in catalog.QUERIES["whole_numbered_evidence"](spark, str(tmp_path)).collect()] == [f"[E1] {long}\n[E2] {'b' * 30}"]
