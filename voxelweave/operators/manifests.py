"""Manifest builders: runs, sentence spans, aligned triplets, regions, sample inclusion, legacy bridges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from voxelweave.checks import code, require_columns
from voxelweave.functions.text import id_range_json
from voxelweave.schemas import CONDITION_CODES, LANGUAGE_CODES, MODEL_CODES


def run_manifest(runs: DataFrame, root: str = "") -> DataFrame:
    """Rename, map language codes, resolve paths below ``root`` and derive validity flags."""
    require_columns(
        runs,
        ["subject_id", "language", "task_name", "original_run_label", "canonical_run_index", "n_volumes",
         "space", "filepath", "is_preproc"],
        "run manifest",
    )
    path = F.col("filepath")
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    valid = F.col("is_preproc").cast("boolean")
    return runs.select(
        "subject_id",
        code("language", LANGUAGE_CODES).alias("language"),
        "task_name",
        F.col("original_run_label").alias("raw_run_label"),
        F.col("canonical_run_index").alias("canonical_run"),
        F.col("canonical_run_index").cast("int").alias("story_section"),
        F.col("n_volumes").alias("n_trs"),
        "space",
        path.alias("prior_relative_bold_path"),
        absolute.alias("bold_path"),
        valid.alias("valid_preproc_bold"),
        (F.col("n_volumes") > 0).alias("valid_n_trs"),
        (valid & (F.col("n_volumes") > 0)).alias("is_valid"),
    )


def sentence_spans(spans: DataFrame, language: str) -> DataFrame:
    text = F.format_string('{"first_word_idx": %d, "last_word_idx": %d}', F.col("first_word_idx").cast("int"), F.col("last_word_idx").cast("int"))
    return spans.select(
        F.lit(language).alias("language"),
        F.col("section_index").cast("int").alias("story_section"),
        F.col("section_index").cast("int").alias("canonical_run"),
        F.col("section_sentence_index").cast("int").alias("section_local_sentence_id"),
        F.col("language_sentence_index").cast("int").alias("global_sentence_id"),
        F.col("text").cast("string").alias("text"),
        F.col("onset_sec").cast("double").alias("onset_sec"),
        F.col("offset_sec").cast("double").alias("offset_sec"),
        F.col("duration_sec").cast("double").alias("duration_sec"),
        F.lit(1).alias("merge_size"),
        text.alias("source_annotation_ids"),
        F.when(F.col("alignment_cost") == 0.0, "ok").otherwise("alignment_cost_nonzero").alias("quality_flag"),
        F.col("n_words").cast("int").alias("n_words"),
        F.col("first_word_idx").cast("int").alias("first_word_idx"),
        F.col("last_word_idx").cast("int").alias("last_word_idx"),
        F.col("alignment_cost").cast("double").alias("alignment_cost"),
    )


def triplets(aligned: DataFrame, qc: DataFrame) -> DataFrame:
    """Aligned triplets LEFT JOIN manual QC; a missing QC row counts as approved and not flagged."""
    merged = aligned.join(qc, ["triplet_id", "section_index"], "left")
    status = F.col("manual_status")
    per_language: list[Column] = []
    for lang in ("en", "fr", "zh"):
        per_language += [
            F.col(f"{lang}_text").cast("string").alias(f"{lang}_text"),
            id_range_json(F.col(f"{lang}_first_sentence_idx"), F.col(f"{lang}_last_sentence_idx")).alias(f"{lang}_sentence_ids"),
            F.col(f"{lang}_onset_sec").cast("double").alias(f"{lang}_onset_sec"),
            F.col(f"{lang}_offset_sec").cast("double").alias(f"{lang}_offset_sec"),
        ]
    return merged.select(
        F.col("triplet_id").cast("bigint").alias("triplet_id"),
        F.col("section_index").cast("int").alias("story_section"),
        F.col("section_index").cast("int").alias("canonical_run"),
        F.col("section_triplet_index").cast("int").alias("section_local_triplet_id"),
        "merge_pattern",
        F.coalesce(F.col("needs_manual_review").cast("boolean"), F.lit(False)).alias("review_flag"),
        (F.coalesce(status, F.lit("approved")) != "approved").alias("repair_flag"),
        F.coalesce(status, F.lit("missing")).alias("qc_manual_status"),
        F.coalesce(F.col("notes"), F.lit("")).alias("qc_notes"),
        *per_language,
    )


def roi_manifest(per_language: Mapping[str, DataFrame]) -> DataFrame:
    """Tag each language's region manifest and union them by name."""
    tagged = [
        df.select(
            "subject_id",
            F.lit(LANGUAGE_CODES[lang]).alias("language"),
            F.col("canonical_run_index").alias("canonical_run"),
            F.col("filepath").cast("string").alias("roi_timeseries_path"),
            "n_scans",
            "n_rois",
        )
        for lang, df in per_language.items()
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def exclusion_reason(expected_runs: int) -> Column:
    """Reasons joined by ';'; NULL branches drop out, included rows give ''."""
    return F.when(F.col("included"), F.lit("")).otherwise(
        F.concat_ws(
            ";",
            F.when(F.col("n_canonical_runs") != expected_runs, F.concat(F.lit("canonical_runs="), F.col("n_canonical_runs").cast("string"))),
            F.when(F.col("n_roi_runs") != expected_runs, F.concat(F.lit("roi_runs="), F.col("n_roi_runs").cast("string"))),
            F.when(~F.col("all_runs_valid"), F.lit("invalid_run_manifest_rows")),
            F.when(F.col("n_rois_observed") <= 0, F.lit("missing_roi_targets")),
        )
    )


def sample_manifest(runs: DataFrame, rois: DataFrame, expected_runs: int = 9) -> DataFrame:
    """Per-subject run and region summaries, FULL OUTER joined, with inclusion and its reason."""
    keys = ["language", "subject_id"]
    known = F.col("language").isNotNull() & F.col("subject_id").isNotNull()
    run_side = runs.where(known).groupBy(*keys).agg(
        F.count_distinct("canonical_run").alias("n_canonical_runs"),
        F.bool_and("is_valid").alias("all_runs_valid"),
        F.sum("n_trs").cast("bigint").alias("n_trs_total"),
    )
    roi_side = rois.where(known).groupBy(*keys).agg(
        F.count_distinct("canonical_run").alias("n_roi_runs"),
        F.max("n_rois").cast("bigint").alias("n_rois_observed"),
        F.sum("n_scans").cast("bigint").alias("n_scans_total"),
    )
    joined = run_side.join(roi_side, keys, "full").na.fill(
        0, ["n_canonical_runs", "n_trs_total", "n_roi_runs", "n_rois_observed", "n_scans_total"]
    ).na.fill(False, ["all_runs_valid"])
    included = (
        (F.col("n_canonical_runs") == expected_runs)
        & (F.col("n_roi_runs") == expected_runs)
        & F.col("all_runs_valid")
        & (F.col("n_rois_observed") > 0)
    )
    return joined.withColumn("included", included).withColumn("exclusion_reason", exclusion_reason(expected_runs))


def included_subject_counts(sample: DataFrame) -> DataFrame:
    return (
        sample.select("language", "subject_id", "included")
        .where("included")
        .groupBy(F.upper("language").alias("language"))
        .agg(F.count_distinct("subject_id").alias("n_subjects"))
    )


def legacy_status(model: Column, condition: Column) -> Column:
    dense, shuffles = model == "nllb", condition == "MISMATCHED_SHARED"
    return (
        F.when(dense & shuffles, "refresh_required_dense_nllb_and_20_shuffle_mismatch")
        .when(dense, "refresh_required_dense_nllb")
        .when(shuffles, "refresh_required_20_shuffle_mismatch")
        .otherwise("reusable_bridge_reference")
    )


def _legacy_names(df: DataFrame) -> DataFrame:
    """Upper-case or map the code columns and add state, block and depth."""
    df = (
        df.withColumn("language", F.upper("language"))
        .withColumn("model", code("model", MODEL_CODES, F.col("model")))
        .withColumn("condition", code("condition", CONDITION_CODES, F.upper("condition")))
        .withColumn("roi_family", F.upper("roi_family"))
        .withColumn("state", F.lit("OUTPUT"))
        .withColumn("block", F.col("layer_index").cast("int"))
        .withColumn("block_depth_norm", F.col("layer_depth").cast("double"))
        .withColumn("source_release", F.lit("prior_paper_release"))
        .withColumnRenamed("roi_name", "roi")
    )
    return df.withColumn("legacy_status", legacy_status(F.col("model"), F.col("condition")))


SUBJECT_BRIDGE_KEYS = [
    "subject_id", "language", "model", "roi_name", "roi_family", "layer_index", "layer_depth", "condition",
]


def subject_bridge(long_metrics: DataFrame) -> DataFrame:
    """Metric rows (r, z, r2) to one wide row per subject, region, layer and condition."""
    wide = long_metrics.groupBy(*SUBJECT_BRIDGE_KEYS).agg(
        *[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(f"{m}_mean") for m in ("r", "z", "r2")]
    )
    return _legacy_names(wide).select(
        "subject_id", "language", "model", "block", "block_depth_norm", "state", "condition", "roi", "roi_family",
        "r_mean", "z_mean", "r2_mean", "legacy_status", "source_release",
    )


def group_bridge(group_rows: DataFrame) -> DataFrame:
    return _legacy_names(group_rows).select(
        "language", "model", "block", "block_depth_norm", "state", "condition", "roi", "roi_family",
        "mean_z", "mean_r", "mean_r2", "se_z", "n_subjects", "legacy_status", "source_release",
    )


def mismatch_shuffle_count(feature_manifest: DataFrame) -> DataFrame:
    """One row: largest shuffle index of the mismatch rows plus one, 0 when there is none."""
    index = F.when(F.col("condition") == "mismatched_shared", F.col("shuffle_index"))
    return feature_manifest.agg(F.coalesce(F.max(index) + 1, F.lit(0)).cast("bigint").alias("legacy_mismatch_shuffle_count"))


def bridge_coverage(subject_rows: DataFrame, shuffle_count: DataFrame) -> DataFrame:
    summary = subject_rows.groupBy("model", "language", "condition").agg(
        F.count_distinct("block").alias("layer_count"),
        F.min("block").alias("layer_min"),
        F.max("block").alias("layer_max"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_distinct("roi").alias("n_rois"),
        F.min("legacy_status").alias("legacy_status"),
    )
    use = F.when(F.col("legacy_status") == "reusable_bridge_reference", "reference_and_schema_bridge").otherwise(
        "reference_only_until_local_refresh"
    )
    return summary.join(shuffle_count).withColumn("bridge_use", use)


def output_feature_manifest(features: DataFrame) -> DataFrame:
    """Map legacy codes; depth is layer / deepest layer (one scalar, joined as a one-row table)."""
    deepest = features.agg(F.greatest(F.lit(1), F.max(F.col("layer_index").cast("int"))).alias("_deepest"))
    return features.join(deepest).select(
        code("model", MODEL_CODES).alias("model"),
        code("language", LANGUAGE_CODES).alias("target_language"),
        F.col("layer_index").cast("int").alias("block"),
        (F.col("layer_index").cast("double") / F.col("_deepest")).alias("block_depth_norm"),
        F.lit("OUTPUT").alias("state"),
        code("condition", CONDITION_CODES).alias("condition"),
        "shuffle_index",
        F.col("feature_dim").cast("int").alias("feature_dim"),
        F.col("n_rows").cast("int").alias("n_rows"),
    )


def output_state_manifest(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        code("model", MODEL_CODES).alias("model"),
        code("language", LANGUAGE_CODES).alias("language"),
        F.col("layer_index").cast("int").alias("block"),
        F.col("layer_depth").cast("double").alias("block_depth_norm"),
        F.lit("OUTPUT").alias("state"),
        F.col("n_rows").cast("int").alias("n_rows"),
        F.col("hidden_size").cast("int").alias("hidden_size"),
        F.col("dtype").cast("string").alias("dtype"),
    )
