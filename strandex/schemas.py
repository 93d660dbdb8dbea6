"""Explicit schemas of banks, samples, subtitles and results: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_AS, _AD, _AF = T.ArrayType(_S), T.ArrayType(_D), T.ArrayType(T.FloatType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One time window of a video. layer 1 is the finest.
CHUNK = struct(
    video_id=_S, layer=_I, idx=_L, chunk_id=_L, start_time=_D, end_time=_D, memory_text=_S, asr=_S, v_dynamic=_AF, v_visual=_AF,
    keyframe_path=_S, keyframe_ts=_D, sampled_frames=_AD, key_events=_AS, actors=_AS, state_changes=_AS, temporal_relations=_AS, causal_clues=_AS, timeline=_AS, causality=_AS,
)

#: A chunk as a bank's JSON document holds it.
BANK_CHUNK = struct(
    chunk_id=_L, start_time=_D, end_time=_D, memory_text=_S, asr=_S, v_dynamic=_AF, v_visual=_AF, keyframe_path=_S, keyframe_ts=_D, sampled_frames=_AD,
    key_events=_AS, actors=_AS, state_changes=_AS, temporal_relations=_AS, causal_clues=_AS,
)
BANK = struct(video_id=_S, duration=_D, memory_kind=_S, chunks=T.ArrayType(BANK_CHUNK), l2_chunks=T.ArrayType(BANK_CHUNK), l3_chunks=T.ArrayType(BANK_CHUNK), l4_chunks=T.ArrayType(BANK_CHUNK))
NARRATIVE = struct(video_id=_S, chunks=T.ArrayType(struct(chunk_id=_L, start_time=_D, end_time=_D, narrative=_S, caption=_AS, speech_text=_S, sampled_frames=_AD, keyframe_ts=_D, keyframe_path=_S, visual_vec=_AF)))
PYRAMID_L1 = struct(idx=_L, t_start=_D, t_end=_D, text=_S, frame_paths=_AS, frame_ts=_AD, visual_offsets=T.ArrayType(_L))
PYRAMID_UPPER = struct(idx=_L, t_start=_D, t_end=_D, text=_S, timeline=_AS, causality=_AS)
SAMPLE = struct(benchmark=_S, sample_idx=_L, video_id=_S, question_id=_S, question_type=_S, question=_S, candidates=_AS, gold_answer=_S, duration_group=_S, duration=_D, video_path=_S)
MLVU = struct(video=_S, duration=_D, question=_S, candidates=_AS, answer=_S)
LONG_VIDEO = struct(video_path=_S, question=_S, candidates=_AS, correct_choice=_I, duration=_D, duration_group=_I, question_category=_S)
CUE = struct(video_id=_S, cue_idx=_I, start_s=_D, end_s=_D, text=_S)
RESULT = struct(
    key=_S, benchmark=_S, question_type=_S, video_id=_S, sample_idx=_L, pipeline=_S, question=_S, candidates=_AS, gold_answer=_S, pred_letter=_S, pred_text=_S, correct=_B,
    evidence_chunk_ids=_AS, n_keyframes_to_answer=_L, n_evidence_to_answer=_L, trace_iters=_L, elapsed=_D, error=_S,
)
FRAME_STATS = struct(path=_S, n_bytes=_L, width=_I, height=_I, px_mean=_D, px_std=_D, lap_var=_D, dhash=_L)
PLAN = struct(strategy=_S, queries=_AS, reasoning=_S)
