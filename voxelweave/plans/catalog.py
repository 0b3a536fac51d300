"""Registered queries: each takes (spark, folder of the given tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxelweave import checks
from voxelweave.functions import ranks, stats
from voxelweave.operators import effects, inference, manifests, upserts
from voxelweave.plans import bindings as b, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, halves up. The guard of 1e-10 makes decimal ties fall alike whatever the
    order in which a sum was formed."""
    def six(name: str) -> Column:
        return (F.floor(F.col(name) * F.lit(1.0e6) + F.lit(0.5001)) / F.lit(1.0e6)).alias(name)

    return df.select(*[six(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


PERMUTATIONS, BOOTSTRAPS, SEED = 10_000, 10_000, 1337


# ------------------------------------------------------------------ manifests

@query
def run_manifest(spark, sf):
    return manifests.run_manifest(b.raw_runs(spark, sf), "/data")


@query
def sentence_spans(spark, sf):
    return rounded(manifests.sentence_spans(b.raw_spans(spark, sf), "EN"))


@query
def triplets_with_qc(spark, sf):
    return rounded(manifests.triplets(b.raw_triplets(spark, sf), b.raw_qc(spark, sf)))


def _runs_and_rois(spark, sf):
    rois = manifests.roi_manifest({lang: b.raw_rois(spark, sf, lang) for lang in ("en", "fr", "zh")})
    return manifests.run_manifest(b.raw_runs(spark, sf), "/data"), rois


@query
def roi_manifest_union(spark, sf):
    return _runs_and_rois(spark, sf)[1]


@query
def sample_manifest(spark, sf):
    return manifests.sample_manifest(*_runs_and_rois(spark, sf), expected_runs=4)


@query
def included_subject_counts(spark, sf):
    return manifests.included_subject_counts(manifests.sample_manifest(*_runs_and_rois(spark, sf), expected_runs=4))


@query
def table1_sample_summary(spark, sf):
    runs, rois = _runs_and_rois(spark, sf)
    return rounded(reports.sample_summary(manifests.sample_manifest(runs, rois, expected_runs=4), rois))


@query
def run_scan_conflicts(spark, sf):
    """Runs whose subjects disagree on the number of scans."""
    return checks.multi_valued(_runs_and_rois(spark, sf)[1], ["language", "canonical_run"], "n_scans")


@query
def missing_subject_runs(spark, sf):
    """Subjects without a manifest row for one of the runs."""
    runs = manifests.run_manifest(b.raw_runs(spark, sf)).where("language IS NOT NULL")
    people = runs.select("language", "subject_id").distinct()
    all_runs = runs.select("canonical_run").distinct()
    return checks.missing_cells(runs, people, all_runs, ["language", "subject_id", "canonical_run"])


@query
def subject_bridge(spark, sf):
    return rounded(manifests.subject_bridge(b.legacy_metrics(spark, sf)))


@query
def bridge_coverage(spark, sf):
    rows = manifests.subject_bridge(b.legacy_metrics(spark, sf))
    return manifests.bridge_coverage(rows, manifests.mismatch_shuffle_count(b.legacy_features(spark, sf)))


@query
def output_feature_manifest(spark, sf):
    return rounded(manifests.output_feature_manifest(b.legacy_features(spark, sf)))


@query
def group_bridge(spark, sf):
    return rounded(manifests.group_bridge(b.legacy_groups(spark, sf)))


@query
def output_state_manifest(spark, sf):
    return rounded(manifests.output_state_manifest(b.output_states(spark, sf)))


# ------------------------------------------------------------------ effects and selection

@query
def group_results(spark, sf):
    return rounded(effects.group_results(b.subject_results(spark, sf)))


@query
def region_deltas(spark, sf):
    return rounded(effects.region_deltas(b.subject_results(spark, sf)))


@query
def subject_family_deltas(spark, sf):
    return rounded(effects.subject_family_deltas(b.subject_results(spark, sf)))


@query
def representative_states(spark, sf):
    return rounded(effects.select_representatives(b.subject_results(spark, sf)))


@query
def representative_states_group_level(spark, sf):
    group = effects.group_results(b.subject_results(spark, sf))
    return rounded(effects.select_representatives(None, group, require_subject_level=False))


@query
def representative_layers(spark, sf):
    source = effects.normalise_group_source(effects.group_results(b.subject_results(spark, sf)))
    return rounded(effects.representative_layers(effects.layer_deltas(source)))


@query
def complete_layer_grid(spark, sf):
    """The selected layers, after a check that every model, language and tested family has exactly one."""
    groups = effects.group_results(b.subject_results(spark, sf))
    expected = groups.where("roi_family <> 'CONTROL'").select("model", "language", "roi_family").distinct().count()
    layers = effects.representative_layers(effects.layer_deltas(effects.normalise_group_source(groups)))
    return rounded(effects.demand_row_count(layers, expected, "representative layers"))


@query
def prioritised_group_tables(spark, sf):
    """Two group tables in two layouts; the later one wins per key."""
    first = effects.normalise_group_source(effects.group_results(b.subject_results(spark, sf)))
    second = b.legacy_metrics(spark, sf).where("metric_name = 'z'").groupBy(
        F.upper("language").alias("language"), "model", "roi_name", F.upper("roi_family").alias("roi_family"), "layer_index", "layer_depth", "condition"
    ).agg(F.avg("value").alias("mean_z"))
    keys = ["language", "model", "roi_name", "roi_family", "layer_index", "condition"]
    return rounded(upserts.latest_by_priority([first, effects.normalise_group_source(second)], keys))


@query
def group_region_deltas(spark, sf):
    return rounded(effects.group_region_deltas(effects.group_results(b.subject_results(spark, sf))))


# ------------------------------------------------------------------ inference

def _contrasts(spark, sf):
    return inference.contrasts(effects.subject_family_deltas(b.subject_results(spark, sf)))


@query
def hypothesis_contrasts(spark, sf):
    return rounded(_contrasts(spark, sf))


@query
def contrast_summary(spark, sf):
    return rounded(inference.effect_summary(_contrasts(spark, sf)))


@query
def sign_flip_tests(spark, sf):
    return rounded(inference.sign_flip_test(_contrasts(spark, sf), PERMUTATIONS, SEED))


@query
def bootstrap_intervals(spark, sf):
    return rounded(inference.bootstrap_interval(_contrasts(spark, sf), BOOTSTRAPS, SEED))


@query
def primary_effects(spark, sf):
    return rounded(inference.primary_effects(_contrasts(spark, sf), permutations=PERMUTATIONS, bootstraps=BOOTSTRAPS, seed=SEED))


@query
def primary_coverage(spark, sf):
    """Cells missing from or extra to a grid that asks for one model too many and one language too few."""
    cells = _contrasts(spark, sf).select(*inference.CELL).distinct()
    return inference.primary_coverage_gaps(cells, ["xlmr", "nllb", "other"], ["EN", "FR"])


@query
def holm_by_supplier(spark, sf):
    """Holm correction of one made-up p per part, one family of tests per brand."""
    parts = b.table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") % 100 / 1000).alias("p_raw"))
    return rounded(ranks.holm(parts, family=["p_brand"]))


@query
def seed_offsets(spark, sf):
    """Stable seed offset of a text key per part."""
    return b.table(spark, sf, "part").select("p_partkey", stats.stable_offset(F.concat_ws("|", "p_brand", "p_type", "p_name")).alias("seed_offset"))


# ------------------------------------------------------------------ upserts and unions

@query
def upsert_by_scope(spark, sf):
    """Rows of one brand and size replace all earlier rows of that scope; NULL scopes match NULL scopes."""
    part = b.table(spark, sf, "part").withColumn("scope", F.when(F.col("p_size") > 10, F.col("p_size")))
    incoming = part.where("p_retailprice > 1500").select("p_brand", "scope", (F.col("p_partkey") + 1000000).alias("p_partkey"))
    return upserts.upsert_scope(part.select("p_brand", "scope", "p_partkey"), incoming, ["p_brand", "scope"])


@query
def replace_exact_rows(spark, sf):
    metrics = b.legacy_metrics(spark, sf)
    local = metrics.where("layer_index = 1").withColumn("value", F.col("value") + 1)
    return rounded(upserts.replace_rows(metrics, local))


@query
def distinct_shard_union(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("triplet_id"))
    lines = b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("triplet_id"))
    return upserts.merge_distinct([orders, lines], ["triplet_id"])


@query
def duplicate_shard_keys(spark, sf):
    """Keys that occur in more than one row of the shards."""
    return checks.duplicate_keys(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def stale_table_rows(spark, sf):
    """Differences between a stored subset of keys and the expected one."""
    expected = b.table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    stored = expected.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    return upserts.table_differences(stored, expected)


@query
def pending_work(spark, sf):
    """(customer, priority) cells of the full grid without an order."""
    done = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    grid = b.table(spark, sf, "customer").select("c_custkey").join(done.select("o_orderpriority").distinct())
    return upserts.pending(grid, done, ["c_custkey", "o_orderpriority"])


@query
def shard_language_gaps(spark, sf):
    """Languages of the merged results against those of a shard list."""
    merged = b.subject_results(spark, sf).select("language")
    listed = b.table(spark, sf, "documents").select(F.upper("lang").alias("language"))
    return checks.coverage_gaps(merged, listed, ["language"])


# ------------------------------------------------------------------ reports

@query
def table4_representative_regions(spark, sf):
    subject = b.subject_results(spark, sf)
    return rounded(reports.representative_regions(effects.select_representatives(subject), effects.group_results(subject)))


@query
def figure2_baseline_deltas(spark, sf):
    return rounded(reports.baseline_deltas(effects.group_results(b.subject_results(spark, sf))))


@query
def figure3_depth_heatmap(spark, sf):
    return rounded(reports.depth_heatmap(effects.group_results(b.subject_results(spark, sf))))


@query
def figure4_primary_panel(spark, sf):
    rows = _contrasts(spark, sf)
    primary = inference.primary_effects(rows, permutations=PERMUTATIONS, bootstraps=BOOTSTRAPS, seed=SEED)
    return rounded(reports.primary_panel(primary, rows))


@query
def table3_confirmatory(spark, sf):
    primary = inference.primary_effects(_contrasts(spark, sf), permutations=PERMUTATIONS, bootstraps=BOOTSTRAPS, seed=SEED)
    return rounded(reports.confirmatory_table(primary))


@query
def scoped_results(spark, sf):
    """Rows of listed languages and states only, ignoring case; an empty list does not filter."""
    scoped = checks.in_scope(b.subject_results(spark, sf), language=["en", "Fr"], state=["ffn"], model=[])
    return scoped.groupBy("model", "language", "state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("n_subjects"))


@query
def figure5_region_curves(spark, sf):
    return rounded(reports.region_curves(effects.group_results(b.subject_results(spark, sf))))


@query
def figure9_region_preference(spark, sf):
    return rounded(reports.region_preference(effects.group_results(b.subject_results(spark, sf))))


@query
def price_percentiles(spark, sf):
    """Exact percentiles of line prices per return flag."""
    return rounded(ranks.exact_percentiles(b.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"ci_low": 0.025, "ci_high": 0.975}))
