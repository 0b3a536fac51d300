"""Report tables and the frames behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxelweave.checks import axis
from voxelweave.functions.ranks import exact_percentiles
from voxelweave.functions.text import marker, roi_stem
from voxelweave.operators.effects import group_region_deltas, real
from voxelweave.schemas import HEATMAP_STATES, TABLE4_STEMS
from voxelweave.session import cut

TOLERANCE = 1.0e-5  # Fixed value: largest difference that counts as equal output.


def sample_summary(sample: DataFrame, rois: DataFrame, tr: float = 2.0) -> DataFrame:
    """Table 1: subjects, runs, mean duration and exclusion reasons per language."""
    reason = F.when(~F.col("included"), F.nullif(F.trim("exclusion_reason"), F.lit("")))
    people = sample.where("language IS NOT NULL").groupBy("language").agg(
        F.count_distinct(F.when(F.col("included"), F.col("subject_id"))).alias("n_subjects"),
        F.coalesce(F.max(F.when(F.col("included"), F.col("n_canonical_runs"))), F.lit(0)).cast("bigint").alias("n_runs"),
        F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("_reasons"),
    )
    kept = sample.where("included").select("language", "subject_id")
    durations = rois.join(kept, ["language", "subject_id"], "left_semi").groupBy("language").agg(
        (F.avg(F.col("n_scans").cast("double")) * tr).alias("mean_duration")
    )
    return people.join(durations, "language", "left").select(
        "language", "n_subjects", "n_runs",
        F.coalesce("mean_duration", F.lit(0.0)).alias("mean_duration"),
        F.lit(tr).alias("TR"),
        F.when(F.col("_reasons") == "", F.lit("none")).otherwise(F.col("_reasons")).alias("any_exclusions"),
    )


def model_inventory(models: DataFrame, states: DataFrame, equivalence: DataFrame | None, bytes_per_value: int = 4) -> DataFrame:
    """Table 2: blocks, states, output equivalence and payload size per model.

    ``models`` has (model, hidden_size, default_states); the size is counted from the stored vectors.
    """
    seen = states.groupBy("model").agg(
        (F.max("block") + 1).cast("bigint").alias("n_blocks"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("_states"),
        (F.sum(F.size("vec")) * bytes_per_value).alias("_bytes"),
    )
    rows = models.join(seen, "model", "left")
    if equivalence is None:
        rows = rows.withColumn("_max", F.lit(None).cast("double"))
    else:
        rows = rows.join(equivalence.groupBy("model").agg(F.max("max_abs_diff").alias("_max")), "model", "left")
    verdict = F.when(F.col("_max").isNull(), "NOT_RUN").when(F.col("_max") <= TOLERANCE, "PASS").otherwise("FAIL")
    megabytes = F.coalesce(F.col("_bytes"), F.lit(0)) / F.lit(1024.0 * 1024.0)
    return rows.select(
        "model", "hidden_size",
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("_states", "default_states").alias("states_extracted"),
        verdict.alias("output_equivalence"),
        F.concat(F.format_string("%.2f", megabytes), F.lit(" MB")).alias("cache_size_summary"),
    )


def confirmatory_table(primary: DataFrame) -> DataFrame:
    """Table 3: the published columns of the primary tests."""
    return primary.select(
        "model", "language", "hypothesis", "effect_mean", "ci_low", "ci_high", "p_raw", "p_holm",
        "n_subjects", "permutation_count", "bootstrap_count",
    )


def representative_regions(reps: DataFrame, group_rows: DataFrame) -> DataFrame:
    """Table 4: the named regions of each representative setting, hemispheres averaged."""
    stems = None
    for family, names in TABLE4_STEMS.items():
        hit = (F.upper("roi_family") == family) & F.col("stem").isin(*names)
        stems = hit if stems is None else stems | hit
    value = real("mean_z")
    rows = group_rows.where(F.col("condition").isin("SHARED", "SPECIFIC")).withColumn("stem", roi_stem(F.col("roi"))).where(stems)
    return (
        rows.join(reps.select("model", "language", "roi_family", "block", "state"), ["model", "language", "roi_family", "block", "state"])
        .groupBy("model", "language", "roi_family", F.col("block").alias("representative_block"), F.col("state").alias("representative_state"), F.col("stem").alias("roi"))
        .agg(
            F.avg(F.when(F.col("condition") == "SHARED", value)).alias("shared_mean_z"),
            F.avg(F.when(F.col("condition") == "SPECIFIC", value)).alias("specific_mean_z"),
        )
        .withColumn("delta_z_mean", F.col("shared_mean_z") - F.col("specific_mean_z"))
    )


def token_class_mass(attributions: DataFrame) -> DataFrame:
    """Table 5: positive attribution per token class and the content share (0 without any mass)."""
    language = "language" if "language" in attributions.columns else "target_language"
    kind = "class" if "class" in attributions.columns else "token_class"
    keys = ["model", "language", "roi_family", "condition"]
    mass = attributions.groupBy(
        "model", F.col(language).alias("language"), "roi_family", "condition", F.col(kind).alias("class")
    ).agg(F.sum(F.greatest("attribution_score", F.lit(0.0))).alias("positive_mass"))
    whole = Window.partitionBy(*keys)
    total = F.sum("positive_mass").over(whole)
    content = F.sum(F.when(F.col("class") == "CONTENT", F.col("positive_mass")).otherwise(F.lit(0.0))).over(whole)
    return mass.withColumn("content_bias", F.when(total > 0, content / total).otherwise(F.lit(0.0)))


def deletion_table(rows: DataFrame) -> DataFrame:
    """Table 6: mean effects and the 2.5 / 97.5 percentiles over subjects."""
    keys = ["model", "language", "roi_family", "k"]
    rows = cut(rows)  # read for the means and for the percentiles
    means = rows.groupBy(*keys).agg(
        F.avg("delta_topk").alias("effect_topk"), F.avg("delta_random").alias("effect_random"), F.avg("delta_diff").alias("diff")
    )
    return means.join(exact_percentiles(rows, keys, "delta_diff", {"ci_low": 0.025, "ci_high": 0.975}), keys)


def baseline_deltas(refresh: DataFrame | None, fallback: DataFrame | None = None) -> DataFrame | None:
    """Figure 2: shared minus specific per family, from whichever of three layouts is present."""
    keys = ["model", "language", "roi_family"]
    if refresh is not None:
        columns = set(refresh.columns)
        value = "mean_z" if "mean_z" in columns else "z_mean" if "z_mean" in columns else None
        if {"condition", "roi_family"} <= columns and value:
            v = real(value)
            return refresh.where(F.col("condition").isin("SHARED", "SPECIFIC")).groupBy(*keys).agg(
                (F.avg(F.when(F.col("condition") == "SHARED", v)) - F.avg(F.when(F.col("condition") == "SPECIFIC", v))).alias("delta_z_mean")
            )
        if "delta_z_mean" in columns:
            return refresh.groupBy(*keys).agg(F.avg("delta_z_mean").alias("delta_z_mean"))
    if fallback is not None and "shared_minus_specific" in fallback.columns:
        return fallback.groupBy(*keys).agg(F.avg("shared_minus_specific").alias("delta_z_mean"))
    return None


def depth_heatmap(group_rows: DataFrame) -> DataFrame:
    """Figure 3: dense state x block grid per panel, regions averaged, gaps NULL."""
    panel = ["model", "language", "roi_family"]
    deltas = group_region_deltas(group_rows).where(F.col("roi_family").isin("SEMANTIC", "AUDITORY"))
    cells = deltas.groupBy(*panel, "state", "block").agg(F.avg("delta_z_mean").alias("delta_z_mean"))
    blocks = cells.groupBy(*panel).agg(F.max("block").alias("_last")).select(*panel, F.explode(F.sequence(F.lit(0), "_last")).alias("block"))
    grid = blocks.join(axis(group_rows.sparkSession, "state", HEATMAP_STATES))
    return grid.join(cells, [*panel, "state", "block"], "left")


def primary_panel(primary: DataFrame, subject_effects: DataFrame) -> DataFrame:
    """Figure 4: subject points beside the cell summary and its significance flag."""
    keys = ["model", "language", "hypothesis"]
    cells = primary.select(*keys, "effect_mean", "ci_low", "ci_high", (F.col("p_holm") < 0.05).alias("significant"))
    return cells.join(subject_effects.select(*keys, "subject_id", "effect_value"), keys, "left")


def region_curves(group_rows: DataFrame) -> DataFrame:
    """Figure 5: mean delta of the named regions by state and depth."""
    named = sorted({s for names in TABLE4_STEMS.values() for s in names})
    return group_region_deltas(group_rows).where(F.col("roi_stem").isin(*named)).groupBy("roi_stem", "state", "block_depth_norm").agg(
        F.avg("delta_z_mean").alias("delta_z_mean")
    )


def attribution_examples(attributions: DataFrame, reps: DataFrame, texts: DataFrame, decimals: int = 10) -> DataFrame:
    """Figure 6: the sentence with the highest mean positive score per family, words marked by strength.

    ``texts`` is (triplet_id, sentence_language, text). Word scores are shown as they are listed, subject by subject.
    """
    setting = ["model", "target_language", "roi_family", "representative_block", "representative_state"]
    chosen = reps.select(
        "model", F.col("language").alias("target_language"), "roi_family",
        F.col("block").alias("representative_block"), F.col("state").alias("representative_state"),
    )
    rows = attributions.join(chosen, setting).withColumn("_positive", F.greatest("attribution_score", F.lit(0.0)))
    means = rows.groupBy(*setting, "triplet_id").agg(F.avg("_positive").alias("_mean"))
    names = {"target_language": "language", "representative_block": "block", "representative_state": "state", "triplet_id": "triplet_row_index"}
    best = best_examples(means.withColumnsRenamed(names), decimals).withColumnsRenamed({new: old for old, new in names.items()})
    return marked_examples(rows.join(best, [*setting, "triplet_id"]), texts)


def best_examples(means: DataFrame, decimals: int = 10) -> DataFrame:
    """The sentence with the highest ``_mean`` of each family: (setting, roi_family, triplet_row_index)."""
    setting = ["model", "language", "block", "state"]
    # max_by keeps one row per family without sorting a family in one task.
    return means.groupBy("roi_family").agg(
        F.max_by(F.struct(*setting, "triplet_row_index"), F.struct(F.round("_mean", decimals), "model", "language", "triplet_row_index")).alias("_b")
    ).select("roi_family", "_b.*")


def marked_examples(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Word scores of chosen sentences as text, with a mark for the strength of each."""
    setting = ["model", "target_language", "roi_family", "representative_block", "representative_state"]
    words = words.withColumn("_positive", F.greatest("attribution_score", F.lit(0.0)))
    sentence = [*setting, "triplet_id", "sentence_language"]
    marked = words.withColumn("_top", F.max("_positive").over(Window.partitionBy(*sentence))).withColumn(
        "_token", F.concat("word_text", F.lit("("), marker(F.col("attribution_score"), F.col("_top")), F.lit(")"))
    )
    order = F.array_sort(F.collect_list(F.struct("word_char_start", "word_index", "subject_id", "_token")))
    listed = marked.groupBy(*sentence).agg(order.alias("_w"))
    return listed.join(texts, ["triplet_id", "sentence_language"], "left").select(
        *sentence, "text", F.array_join(F.col("_w._token"), " ").alias("marked")
    )


def class_mass_means(table5: DataFrame) -> DataFrame:
    """Figure 7: mean positive mass by family and class."""
    return table5.groupBy("roi_family", "class").agg(F.avg("positive_mass").alias("positive_mass"))


def deletion_curves(table6: DataFrame) -> DataFrame:
    """Figure 8: top-k and random effects by family and k."""
    return table6.select("roi_family", "k", "model", "language", "effect_topk", "effect_random").orderBy("roi_family", "k", "model", "language")


def region_preference(group_rows: DataFrame) -> DataFrame:
    """Figure 9: mean delta by family and region."""
    return group_region_deltas(group_rows).groupBy("roi_family", "roi").agg(F.avg("delta_z_mean").alias("delta_z_mean"))


