"""Readers, writers and image statistics on files made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex import schemas
from strandex.sources import images, readers, stills, writers

SRT = """1
00:00:01,000 --> 00:00:02,500
<i>Hello</i>
there

2
00:00:03.000 --> 00:00:04.000
42

3
00:00:05,000 --> 00:00:06,000
last"""


def test_subtitles(spark, tmp_path):
    (tmp_path / "vid.srt").write_text(SRT)
    want = [("vid", 1.0, 2.5, "Hello there"), ("vid", 5.0, 6.0, "last")]
    got = readers.subtitles(spark, str(tmp_path)).orderBy("start_s").collect()
    assert [(r.video_id, r.start_s, r.end_s, r.text) for r in got] == want
    native = readers.subtitles_native(spark.createDataFrame([("vid", SRT)], "video_id string, value string")).orderBy("start_s").collect()
    assert [(r.video_id, r.start_s, r.end_s, r.text) for r in native] == want


def test_malformed_subtitles(spark):
    """Time lines close what is open, blank lines count only after text, what follows a closed cue is nobody's, and a byte order mark does no harm."""
    body = "\ufeffnoise\r\n00:00:01,000 --> 00:00:02,000\r\n\r\n  first <b>one</b> \r\nmore\r\n00:00:03.000-->00:00:04.500 align:left\r\n7\r\nsecond\r\n \t\r\nlost\r\n9\r\n00:00:05,000 --> 00:00:06,000\r\n<i></i>\r\n\r\n00:00:07,000 --> 00:00:08,000\r\n\r\n\r\n12\r\n00:00:09,000 --> 00:00:10,000\r\nlast"
    rows = spark.createDataFrame([("v", body), ("w", ""), ("x", None), ("y", "no cue")], "video_id string, value string")
    got = sorted((r.video_id, r.cue_idx, r.start_s, r.end_s, r.text) for r in readers.subtitles_native(rows).collect())
    assert got == [("v", 0, 1.0, 2.0, "first one more"), ("v", 1, 3.0, 4.5, "second"), ("v", 2, 9.0, 10.0, "last")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"video_id": "x"}\n\nnot json\n{"video_id": "y"}\n')
    assert sorted(r.video_id for r in readers.video_filter(spark, str(tmp_path)).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.jsonl(spark, str(tmp_path), "video_id string").collect()


def test_benchmarks(spark, tmp_path):
    rows = [("v1", "long", "q2", "t", "Q?", ["A. cat", "B. dog"], "B"), ("v2", "short", "q1", "t", "Q?", ["A. x"], "A"), ("v3", "long", "q0", "t", "Q?", ["A. p", "B. q"], "A")]
    spark.createDataFrame(rows, "videoID string, duration string, question_id string, task_type string, question string, options array<string>, answer string").write.parquet(str(tmp_path / "mme"))
    got = readers.videomme(spark, str(tmp_path / "mme"), ["long"]).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.question_id, r.candidates[1], r.gold_answer) for r in got] == [(0, "q2", "dog", "dog"), (1, "q0", "q", "p")]
    (tmp_path / "mlvu").mkdir()
    item = lambda video, q: {"video": video, "duration": 9, "question": q, "candidates": ["1", "2"], "answer": "2"}
    (tmp_path / "mlvu/count.json").write_text(json.dumps([{"video": "b.mp4", "question": "open"}] + [item("c.mp4", f"z{i}") for i in range(3)] + [item("a.mp4", "y")]))
    (tmp_path / "mlvu/order.json").write_text(json.dumps([item("b.mp4", "x"), item("a.mp4", "w")]))
    got = readers.mlvu(spark, str(tmp_path / "mlvu"), per_video=2).collect()
    assert sorted((r.question_type, r.sample_idx, r.video_id, r.question) for r in got) == [("count", 1, "c", "z0"), ("count", 2, "c", "z1"), ("count", 4, "a", "y"), ("order", 0, "b", "x"), ("order", 1, "a", "w")]
    got = readers.mlvu(spark, str(tmp_path / "mlvu"), ["order", "count"], videos=2, per_video=1).collect()
    assert sorted((r.question_type, r.sample_idx, r.video_id) for r in got) == [("order", 0, "b"), ("order", 1, "a")]
    (tmp_path / "lvb.json").write_text(json.dumps([{"video_path": "z/c.mp4", "question": "q", "candidates": ["x", "y"], "correct_choice": 1, "duration": 5, "duration_group": 15, "question_category": "k"}]))
    r = readers.long_video(spark, str(tmp_path / "lvb.json"), [15]).first()
    assert (r.video_id, r.gold_answer) == ("c", "y")


def test_benchmark_numbers_at_size(spark, tmp_path):
    """Numbers follow the file's order whatever the question ids, over more rows than a range partitioner samples."""
    n = 500_000
    rows = spark.range(n, numPartitions=1).select(F.lit("long").alias("duration"), F.concat(F.lit("v"), F.col("id") % 97).alias("videoID"), F.md5(F.col("id").cast("string")).alias("question_id"), F.lit("t").alias("task_type"), F.col("id").cast("string").alias("question"), F.array(F.lit("A. x"), F.lit("B. y")).alias("options"), F.lit("A").alias("answer"))
    rows.write.parquet(str(tmp_path / "mme"))
    got = readers.videomme(spark, str(tmp_path / "mme"), ["long"])
    assert got.where("sample_idx <> cast(question as bigint)").count() == 0 and got.select("sample_idx").distinct().count() == n


def test_video_files(spark, tmp_path):
    for p in ("a/x.mp4", "b/x.mkv", "b/y.avi", "b/z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    got = {r.video_id: r.path for r in readers.video_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["x", "y"] and got["x"].endswith("a/x.mp4")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/b/y.avi\n\n  {tmp_path}/a/x.mp4 \n")
    assert sorted(r.video_id for r in readers.videos(spark, str(tmp_path / "list.txt")).collect()) == ["x", "y"]
    assert [r.video_id for r in readers.videos(spark, str(tmp_path / "b/x.mkv")).collect()] == ["x"]
    assert sorted(r.video_id for r in readers.videos(spark, str(tmp_path)).collect()) == ["x", "y"]


def chunk_rows(spark, rows):
    have = spark.createDataFrame(rows, "video_id string, layer int, chunk_id bigint, start_time double, end_time double, memory_text string")
    return have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.CHUNK])


def test_banks_round_trip(spark, tmp_path):
    rows = [("v", 1, 1, 0.0, 4.0, "b"), ("v", 1, 0, 0.0, 2.0, "a"), ("v", 2, 100000, 0.0, 4.0, "up"), ("w", 1, 0, 0.0, 9.0, "c")]
    c = chunk_rows(spark, rows)
    writers.save_banks(c, str(tmp_path / "banks"))
    got = readers.bank(spark, str(tmp_path / "banks"), "lines").collect()
    assert sorted((r.video_id, r.layer, r.chunk_id, r.memory_text) for r in got) == sorted((a, b, k, t) for a, b, k, _, _, t in rows)
    writers.save_layers(c, str(tmp_path / "layers"))
    assert writers.done_layers(spark, str(tmp_path / "layers")) == {1, 2} and writers.done_layers(spark, str(tmp_path / "none")) == set()
    writers.save_meta(c, str(tmp_path / "meta"))
    meta = {r.video_id: r for r in spark.read.json(str(tmp_path / "meta")).collect()}
    assert (meta["v"].duration, meta["v"].l1, meta["v"].layers_present) == (4.0, 2, "1,2")


def test_layers_are_atomic_and_resume(spark, tmp_path):
    """A build that dies half way has no part of what it was writing, and going on gives what a fresh build gives."""
    rows = [("v", k, i, float(i), i + 1.0, f"t{k}{i}") for k in (1, 2, 3) for i in range(20 // k)]
    c = chunk_rows(spark, rows).repartition(4)
    path = str(tmp_path / "bank")
    dies = F.udf(lambda i: 1 // (0 if i == 7 else 1) + i, "bigint")
    layer = lambda k: c.where(F.col("layer") == k)
    up = lambda at: writers.load_part(spark, at, "L1").withColumn("layer", F.lit(2))
    with pytest.raises(Exception, match="ZeroDivision"):
        writers.resumed(spark, path, {"L1": lambda: layer(1), "L2": lambda: up(path).withColumn("chunk_id", dies("chunk_id"))})
    assert writers.done_layers(spark, path) == {1} and [p.name[:2] for p in (tmp_path / "bank/data").iterdir()].count("L2") == 1
    assert writers.resumed(spark, path, {"L1": lambda: layer(1), "L2": lambda: up(path), "L3": lambda: layer(3)}) == ["L2", "L3"]
    fresh = str(tmp_path / "fresh")
    writers.resumed(spark, fresh, {"L1": lambda: layer(1), "L2": lambda: up(fresh), "L3": lambda: layer(3)})
    for k in (1, 2, 3):
        a, b = (sorted(map(repr, writers.load_part(spark, at, f"L{k}").collect())) for at in (path, fresh))
        assert a == b and a
    writers.save_layers(c.limit(0), path, [4])
    assert writers.done_layers(spark, path) == {1, 2, 3, 4} and writers.load_part(spark, path, "L4").count() == 0
    writers.save_visual(spark.createDataFrame([("v", 0, 1, 2.0, [1.0, 0.0])], "video_id string, idx bigint, frame int, ts double, v_visual array<double>"), path)
    assert writers.manifests(spark, path)["visual"]["rows"] == 1 and writers.load_part(spark, path, "visual").first().v_visual == [1.0, 0.0]


def test_results_append(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    for _ in range(2):
        writers.append_results(rows, str(tmp_path / "out"))
    got = readers.jsonl(spark, str(tmp_path / "out"), "key string, x int")
    assert sorted((r.key, r.x) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 2), ("b", 2)]
    frames = spark.createDataFrame([("v", 1, "x"), ("v", 2, "y")], "video_id string, chunk_id bigint, path string")
    c = spark.createDataFrame([("v", 1), ("v", 2), ("v", 3)], "video_id string, chunk_id bigint")
    assert [r.path for r in readers.keyframes(c, frames.where("chunk_id = 1"), frames.withColumn("path", F.upper("path"))).orderBy("chunk_id").collect()] == ["x", "Y", None]
    timed = images.frame_times(spark.createDataFrame([("v", "f2"), ("v", "f1")], "video_id string, path string"), "video_id", 2.0).orderBy("path").collect()
    assert [(r.frame_idx, r.ts) for r in timed] == [(0, 0.0), (1, 0.5)]


def test_frame_files(spark, tmp_path):
    for p in ("v/keyframes_origin/0003_a.jpg", "v/keyframes_origin/0003_b.jpg", "v/keyframes_origin/c00003_f00.jpg", "v/keyframes_origin/c00004_f01.jpg", "v/frames/0009_a.jpg", "w/frames/0009_a.jpg", "w/frames/notes.jpg", "w/other/0001_a.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    got = sorted((r.video_id, r.chunk_id, r.path.rsplit("/", 1)[1]) for r in readers.frame_files(spark, str(tmp_path)).collect())
    assert got == [("v", 3, "0003_a.jpg"), ("v", 3, "0003_b.jpg"), ("v", 4, "c00004_f01.jpg"), ("w", 9, "0009_a.jpg")]


def test_legacy_bank(spark, tmp_path):
    d = tmp_path / "vid"
    d.mkdir()
    (d / "narrative.json").write_text(json.dumps({"video_id": "vid", "chunks": [{"chunk_id": 5, "narrative": "", "caption": ["x", "y"]}, {"chunk_id": 7, "narrative": "n", "visual_vec": [9.0]}]}))
    np.savez(d / "vectors.npz", chunk_ids=np.array([5]), narrative_vecs=np.array([[1.0, 2.0]], np.float32), visual_vecs=np.array([[3.0, 4.0]], np.float32))
    got = {r.chunk_id: r for r in readers.bank(spark, str(tmp_path), "legacy").collect()}
    assert (got[5].memory_text, got[5].v_dynamic, got[5].v_visual) == ("x | y", [1.0, 2.0], [3.0, 4.0])
    assert (got[7].memory_text, got[7].v_dynamic, got[7].v_visual) == ("n", None, [9.0])


def test_pyramid_bank(spark, tmp_path):
    d = tmp_path / "vid"
    d.mkdir()
    first = [{"idx": 0, "t_start": 0.0, "t_end": 10.0, "text": "a", "frame_paths": ["f0", "f1"], "frame_ts": [1.0, 2.0], "visual_offsets": [0, 1]}, {"idx": 2, "t_start": 20.0, "t_end": 30.0, "text": "b", "frame_paths": [], "frame_ts": [], "visual_offsets": []}]
    (d / "L1.jsonl").write_text("\n".join(map(json.dumps, first)))
    for k in (2, 3, 4):
        (d / f"L{k}.jsonl").write_text(json.dumps({"idx": 0, "t_start": 0.0, "t_end": 30.0, "text": "up", "timeline": ["p", "q"], "causality": ["r"]}))
    np.savez(d / "v.npz", L1_text=np.array([[1.0, 0.0], [0.0, 1.0]]), L2_text=np.ones((1, 2)), L3_text=np.ones((1, 2)), L4_text=np.ones((1, 2)), L1_visual=np.array([[1.0, 0.0], [0.0, 1.0]]))
    got = {r.chunk_id: r for r in readers.bank(spark, str(tmp_path), "pyramid").collect()}
    assert (got[0].v_visual, got[0].keyframe_path, got[2].v_dynamic, got[2].v_visual) == ([0.5, 0.5], "f0", [0.0, 1.0], [0.0, 0.0])
    assert got[100000].memory_text == "[L2][0s-30s] up\nTimeline: p → q"
    assert readers.bank(spark, str(d)).count() == 5
    (tmp_path / "one.json").write_text(json.dumps({"video_id": "one", "chunks": [{"chunk_id": 1, "memory_text": "x"}]}))
    assert [r.memory_text for r in readers.bank(spark, str(tmp_path / "one.json")).collect()] == ["x"]
    assert [r.memory_text for r in readers.bank(spark, str(tmp_path / "one")).collect()] == ["x"]
    with pytest.raises(ValueError, match="bank"):
        readers.bank(spark, str(tmp_path / "nothing"))


def test_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise, flat = rng.integers(0, 255, (32, 48), np.uint8), np.full((32, 48), 3, np.uint8)
    for name, px in (("noise", noise), ("flat", flat)):
        (tmp_path / f"{name}.pgm").write_bytes(b"P5\n48 32\n255\n" + px.tobytes())
    (tmp_path / "bad.pgm").write_bytes(b"nothing")
    got = {r.path.rsplit("/")[-1]: r for r in images.frame_statistics(spark, str(tmp_path)).withColumn("blank", images.is_blank(F.lit(5000), F.col("px_mean"), F.col("px_std"))).withColumn("blurry", images.is_blurry(F.col("lap_var"))).collect()}
    assert (got["noise.pgm"].blank, got["noise.pgm"].blurry, got["noise.pgm"].width, got["noise.pgm"].height) == (False, False, 48, 32)
    assert got["flat.pgm"].blank and got["flat.pgm"].blurry and got["bad.pgm"].blank and got["bad.pgm"].dhash is None
    assert images.dhash(np.tile(np.arange(9.0, 0, -1), (8, 1))) == -1 and images.dhash(np.tile(np.arange(9.0), (8, 1))) == 0


def test_stills(spark, tmp_path):
    """Frames by byte ranges: split counts, times and indexes, and no frame read where content isn't asked for."""
    rng = np.random.default_rng(1)
    want = {}
    for v, n in (("a", 10), ("b", 3), ("none", 0)):
        frames = [(i / 2, b"P5\n8 4\n255\n" + rng.integers(0, 255, 32, np.uint8).tobytes() + b"x" * i) for i in range(n)]
        stills.write(str(tmp_path / f"{v}.stills"), frames, n / 2)
        want |= {(v, i): (ts, body, n / 2) for i, (ts, body) in enumerate(frames)}
    (tmp_path / "notes.txt").write_text("no container")
    stills.register(spark)
    for size, splits in ((1 << 20, 2), (100, 8), (1, 13)):
        df = spark.read.format("stills").option("splitBytes", size).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == splits, (size, df.rdd.getNumPartitions())
        assert {(r.video_id, r.frame_idx): (r.ts, bytes(r.content), r.duration) for r in df.collect()} == want
    narrow = spark.read.format("stills").schema("video_id string, ts double, duration double").load(str(tmp_path))
    assert narrow.groupBy("video_id").agg(F.max("ts").alias("t"), F.max("duration").alias("d")).orderBy("video_id").collect() == [("a", 4.5, 5.0), ("b", 1.0, 1.5)]
    reader = stills.Reader(narrow.schema, {"path": str(tmp_path)})
    assert reader.partitions()[0].last == 10 and next(reader.read(reader.partitions()[0])).schema.names == ["video_id", "ts", "duration"]
    (tmp_path / "bad.stills").write_bytes(b"STILLS1\n" * 9)
    with pytest.raises(Exception, match="no container"):
        spark.read.format("stills").load(str(tmp_path)).count()


def test_resized(spark):
    px = np.arange(8 * 4 * 3, dtype=np.uint8).reshape(4, 8, 3)
    rows = spark.createDataFrame([("x", bytearray(images.encode(px))), ("bad", bytearray(b"nothing")), ("none", None)], "path string, content binary")
    got = {r.path: r.content and bytes(r.content) for r in images.resized(rows, longest=4).collect()}
    small = images.decode(got["x"])
    assert small.shape == (2, 4, 3) and got["bad"] == b"nothing" and got["none"] is None
    assert abs(int(small[0, 0, 0]) - px[:2, :2, 0].mean()) <= 1
    assert images.decode(bytes(images.resized(rows, shortest=2).where("path = 'x'").first().content)).shape == (2, 4, 3)
    assert bytes(images.resized(rows, longest=8).where("path = 'x'").first().content) == images.encode(px)
