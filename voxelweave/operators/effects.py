"""Shared-minus-specific effects at region, family, setting and group level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from voxelweave.checks import ContractError, require_columns
from voxelweave.functions.text import roi_stem
from voxelweave.schemas import STATES

DELTA_KEYS = ("subject_id", "language", "model", "block", "state", "roi", "roi_family")
GROUP_KEYS = ("language", "model", "block", "block_depth_norm", "state", "condition", "roi", "roi_family")


def real(column: str):
    """A double column with NaN turned into NULL, so that averages skip it."""
    c = F.col(column).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def condition_pair(df: DataFrame, keys: Sequence[str], value: str, labels=("SHARED", "SPECIFIC")) -> DataFrame:
    """Both conditions of a key side by side in one aggregation instead of a self-join."""
    left, right = labels
    known = [F.col(k).isNotNull() for k in keys]
    kept = df.where(F.col("condition").isin(left, right))
    for k in known:
        kept = kept.where(k)
    return kept.groupBy(*keys).agg(
        F.max(F.when(F.col("condition") == left, real(value))).alias("shared"),
        F.max(F.when(F.col("condition") == right, real(value))).alias("specific"),
    )


def region_deltas(subject_results: DataFrame) -> DataFrame:
    """INNER pairing: regions with both conditions, delta_z = shared - specific."""
    pairs = condition_pair(subject_results, DELTA_KEYS, "z_mean").where("shared IS NOT NULL AND specific IS NOT NULL")
    return pairs.withColumn("delta_z", F.col("shared") - F.col("specific"))


def subject_family_deltas(subject_results: DataFrame) -> DataFrame:
    """Mean region delta per subject, family, block and state."""
    require_columns(subject_results, [*DELTA_KEYS, "condition", "z_mean"], "subject results")
    return region_deltas(subject_results).groupBy(
        "subject_id", "language", "model", "roi_family", "block", "state"
    ).agg(F.avg("delta_z").alias("delta_z"))


def setting_deltas(subject_results: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """Two-level mean: regions within subject and family first, then subjects within setting."""
    family = subject_family_deltas(subject_results.where(F.col("state").isin(*states)))
    return (
        family.groupBy("model", "language", "roi_family", "block", "state")
        .agg(F.avg("delta_z").alias("delta_z_mean"))
        .withColumn("source_level", F.lit("subject"))
    )


def group_setting_deltas(group_results: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """The same candidates from group rows only (one level)."""
    require_columns(
        group_results, ["language", "model", "block", "state", "condition", "roi", "roi_family", "mean_z"], "group results"
    )
    pairs = condition_pair(
        group_results.where(F.col("state").isin(*states)),
        ("model", "language", "roi_family", "block", "state", "roi"),
        "mean_z",
    )
    return (
        pairs.withColumn("delta_z", F.col("shared") - F.col("specific"))
        .groupBy("model", "language", "roi_family", "block", "state")
        .agg(F.avg("delta_z").alias("delta_z_mean"))
        .withColumn("source_level", F.lit("group"))
    )


def group_results(subject_results: DataFrame) -> DataFrame:
    """Mean z, mean r and distinct subjects per setting and region; confidence limits stay empty."""
    known = subject_results
    for key in GROUP_KEYS:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*GROUP_KEYS).agg(
        F.avg(real("z_mean")).alias("mean_z"),
        F.avg(real("r_mean")).alias("mean_r"),
        F.lit(None).cast("double").alias("ci_low"),
        F.lit(None).cast("double").alias("ci_high"),
        F.count_distinct("subject_id").alias("n_subjects"),
    )


def group_region_deltas(group_rows: DataFrame) -> DataFrame:
    """Per-region difference of group means, with the hemisphere-free stem."""
    keys = ("language", "model", "roi", "roi_family", "block", "block_depth_norm", "state")
    return (
        condition_pair(group_rows, keys, "mean_z")
        .withColumn("delta_z_mean", F.col("shared") - F.col("specific"))
        .withColumn("roi_stem", roi_stem(F.col("roi")))
    )


def normalise_group_source(df: DataFrame) -> DataFrame:
    """Accept the block layout (OUTPUT rows only) or the layer layout; give layer columns."""
    columns = set(df.columns)
    if {"block", "block_depth_norm", "state", "roi", "roi_family", "condition", "mean_z", "model", "language"} <= columns:
        df = df.where(F.upper("state") == "OUTPUT")
        layer, depth, name = "block", "block_depth_norm", "roi"
    elif {"layer_index", "layer_depth", "roi_name", "roi_family", "condition", "mean_z", "model", "language"} <= columns:
        layer, depth, name = "layer_index", "layer_depth", "roi_name"
    else:
        raise ContractError(f"Unsupported group table columns: {sorted(columns)}")
    return df.select(
        "language", "model", "roi_family", "mean_z",
        F.col(name).cast("string").alias("roi_name"),
        F.col(layer).cast("int").alias("layer_index"),
        F.col(depth).cast("double").alias("layer_depth"),
        F.lower("condition").alias("condition"),
    )


def layer_deltas(group_rows: DataFrame) -> DataFrame:
    """Family means per layer and condition, difference shared - specific."""
    rows = (
        group_rows.withColumn("language", F.upper("language"))
        .withColumn("roi_family", F.upper("roi_family"))
        .withColumn("model", F.when(F.col("model") == "nllb_encoder", "nllb").otherwise(F.col("model")))
    )
    value = real("mean_z")
    return (
        rows.where(F.col("condition").isin("shared", "specific"))
        .groupBy("model", "language", "roi_family", "layer_index", "layer_depth")
        .agg(
            F.avg(F.when(F.col("condition") == "shared", value)).alias("shared"),
            F.avg(F.when(F.col("condition") == "specific", value)).alias("specific"),
        )
        .withColumn("shared_minus_specific", F.col("shared") - F.col("specific"))
    )


def state_rank(state):
    out = F.when(state == STATES[0], 0)
    for i, name in enumerate(STATES[1:], start=1):
        out = out.when(state == name, i)
    return out.otherwise(len(STATES))


def representatives(candidates: DataFrame, decimals: int = 10) -> DataFrame:
    """Best setting per model, language and family: delta, then shallower block, then state order.

    Scores are rounded before ranking so that equal scores tie whatever the summation order.
    """
    score = F.round("delta_z_mean", decimals)
    best = Window.partitionBy("model", "language", "roi_family").orderBy(
        score.desc_nulls_last(), F.col("block"), state_rank(F.col("state")), F.col("state")
    )
    return (
        candidates.withColumn("_rank", F.row_number().over(best))
        .where("_rank = 1")
        .select(
            "model", "language", "roi_family", "block", "state",
            F.lit("max_mean_subject_shared_minus_specific").alias("selection_metric"),
            "delta_z_mean", "source_level",
            F.lit("ties broken toward shallower block then state order ATTN, POST_ATTN, FFN, OUTPUT").alias("tie_break_notes"),
        )
    )


def select_representatives(
    subject_results: DataFrame | None, group_rows: DataFrame | None = None, *, require_subject_level: bool = True
) -> DataFrame:
    """Subject-level candidates by default; group-level ones only when allowed."""
    if subject_results is not None:
        return representatives(setting_deltas(subject_results))
    if require_subject_level or group_rows is None:
        raise ContractError("Representative selection needs subject-level results.")
    return representatives(group_setting_deltas(group_rows))


def representative_layers(deltas: DataFrame, families=("SEMANTIC", "AUDITORY"), decimals: int = 10) -> DataFrame:
    """Best OUTPUT layer per model, language and family; ties go to the shallower layer."""
    best = Window.partitionBy("model", "language", "roi_family").orderBy(
        F.round("shared_minus_specific", decimals).desc_nulls_last(), "layer_index"
    )
    return (
        deltas.where(F.col("roi_family").isin(*families))
        .withColumn("_rank", F.row_number().over(best))
        .where("_rank = 1")
        .select(
            "model", "language", "roi_family",
            F.col("layer_index").alias("block"),
            F.col("layer_depth").alias("block_depth_norm"),
            F.lit("OUTPUT").alias("state"),
            F.lit("max_group_mean_shared_minus_specific").alias("selection_metric"),
            F.col("shared_minus_specific").alias("delta_z_mean"),
            F.lit("ties broken toward shallower layer").alias("tie_break_notes"),
        )
    )


def demand_row_count(df: DataFrame, expected: int, label: str) -> DataFrame:
    seen = df.count()
    if seen != expected:
        raise ContractError(f"{label}: expected {expected} rows, got {seen}")
    return df
