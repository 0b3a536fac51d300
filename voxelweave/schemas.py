"""Table schemas and the fixed vocabularies of the study design."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the design.
LANGUAGES = ("EN", "FR", "ZH")
STATES = ("ATTN", "POST_ATTN", "FFN", "OUTPUT")
HEATMAP_STATES = ("INPUT", "ATTN", "POST_ATTN", "FFN", "OUTPUT")
ATTENTION_STATES = ("ATTN", "POST_ATTN")
FEEDFORWARD_STATES = ("FFN", "OUTPUT")
H1 = "H1_semantic_ffn_preference"
H2 = "H2_auditory_attention_preference"
MODEL_CODES = {"xlmr": "xlmr", "nllb_encoder": "nllb"}
LANGUAGE_CODES = {"en": "EN", "fr": "FR", "zh": "ZH"}
CONDITION_CODES = {
    "acoustic_only": "ACOUSTIC_ONLY",
    "full": "FULL",
    "mismatched_shared": "MISMATCHED_SHARED",
    "raw": "RAW",
    "shared": "SHARED",
    "specific": "SPECIFIC",
}
TABLE4_STEMS = {"SEMANTIC": ("AG", "IFGtri"), "AUDITORY": ("pSTG", "Heschl")}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
VECTOR = T.ArrayType(T.FloatType())
DVECTOR = T.ArrayType(T.DoubleType())
SPAN = _struct(("start", _I), ("end", _I))

SUBJECT_RESULTS = _struct(
    ("subject_id", _S), ("language", _S), ("model", _S), ("block", _I), ("block_depth_norm", _D),
    ("state", _S), ("condition", _S), ("roi", _S), ("roi_family", _S), ("z_mean", _D), ("r_mean", _D),
    ("r2_concat", _D), ("alpha_best_mode", _D), ("alpha_best_mean_log10", _D), ("n_pcs_mean", _D),
    ("n_outer_folds", _L), ("n_timepoints_total", _L), ("seed", _L),
)
GROUP_RESULTS = _struct(
    ("language", _S), ("model", _S), ("block", _I), ("block_depth_norm", _D), ("state", _S),
    ("condition", _S), ("roi", _S), ("roi_family", _S), ("mean_z", _D), ("mean_r", _D),
    ("ci_low", _D), ("ci_high", _D), ("n_subjects", _L),
)
STATE_VECTORS = _struct(
    ("model", _S), ("language", _S), ("state", _S), ("block", _I), ("block_depth_norm", _D),
    ("triplet_row_index", _L), ("vec", VECTOR),
)
SENTENCE_TIMING = _struct(
    ("language", _S), ("canonical_run", _I), ("triplet_row_index", _L), ("onset_sec", _D), ("offset_sec", _D),
)
BOLD = _struct(
    ("language", _S), ("subject_id", _S), ("canonical_run", _I), ("scan", _I), ("roi_index", _I), ("value", T.FloatType()),
)
TOKEN_METADATA = _struct(
    ("model", _S), ("language", _S), ("triplet_id", _L), ("text", _S), ("sequence_length", _I),
    ("n_tokens_pooled", _I), ("first_pooled_token_index", _I), ("last_pooled_token_index", _I),
    ("token_ids", T.ArrayType(_I)), ("token_strings", T.ArrayType(_S)), ("char_offsets", T.ArrayType(SPAN)),
    ("pooled_token_indices", T.ArrayType(_I)), ("has_offset_mapping", _B),
)
DELETION_ROWS = _struct(
    ("subject_id", _S), ("model", _S), ("language", _S), ("roi_family", _S), ("representative_block", _I),
    ("representative_state", _S), ("k", _I), ("base_z", _D), ("topk_z", _D), ("random_z_mean", _D),
    ("delta_topk", _D), ("delta_random", _D), ("delta_diff", _D), ("n_random_draws", _I), ("matching_policy", _S),
)
PROGRESS_EVENT = _struct(
    ("timestamp_utc", _S), ("event", _S), ("model", _S), ("target_language", _S), ("roi_family", _S),
    ("block", _I), ("state", _S), ("subject_id", _S),
)
PROGRESS_DOCUMENT = _struct(
    ("status", _S), ("model", _S), ("target_language", _S), ("roi_family", _S), ("representative_block", _I),
    ("representative_state", _S), ("started_utc", _S), ("updated_utc", _S), ("resume_count", _I),
    ("subject_ids_total", _I), ("subject_ids", T.ArrayType(_S)), ("completed_subject_ids", T.ArrayType(_S)),
    ("current_subject_id", _S), ("current_subject_index", _I), ("rows_written", _L), ("deletion_ks", T.ArrayType(_I)),
    ("subject_progress", T.MapType(_S, _struct(("status", _S), ("completed_ks", T.ArrayType(_I)), ("updated_utc", _S)))),
    ("last_error", _S),
)
