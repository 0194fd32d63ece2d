"""Schemas of the files of a run."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _fields(kind, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


QUESTION = T.StructType([T.StructField("id", _L), T.StructField("question", _S), T.StructField("options", T.ArrayType(_S)), T.StructField("answer", T.ArrayType(_S))])
META = T.StructType(
    _fields(_S, "output_type model_id lora_adapter_path raw boxed cleaned_response extractor_path malformed_reason confidence_tier finalizer_extractor_path raw_letter_recovery_path verify_reason stop_policy")
    + _fields(_I, "n_tokens finalizer_n_tokens total_n_tokens pre_trunc_n_tokens boxed_count_in_raw verify_score selected_boxed_index expected_ans_slots")
    + _fields(_B, "is_mcq generation_hit_max raw_was_post_truncated raw_was_truncated finalizer_used option_match_used fallback_used malformed_output training_echo_detected guessed_letter_used raw_letter_recovered verify_triggered boxed_fallback_used phrase_override cue_matched")
    + [T.StructField("extracted_values", T.ArrayType(_S))]
)
RECORD = T.StructType([T.StructField("id", _L), T.StructField("is_mcq", _B), T.StructField("response", _S), T.StructField("meta", META), T.StructField("raw", _S)])
EXAMPLE = T.StructType(_fields(_S, "prompt target example_type system_prompt source target_kind answer_letter"))
EVENT = T.StructType([T.StructField("event_id", _L), T.StructField("ts", T.TimestampType()), T.StructField("user_id", _L), T.StructField("event_type", _S), T.StructField("value", T.DoubleType()), T.StructField("props", _S)])
