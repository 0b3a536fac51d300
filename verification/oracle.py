"""SQL of every registered query, for DuckDB on the given tables."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def r(expression: str, name: str | None = None) -> str:
    """Six decimals, halves up with the guard of the queries."""
    return f"floor(({expression}) * 1e6 + 0.5001e0) / 1e6 AS {name or expression}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def compose(final: str) -> str:
    """Prefix a statement with the views it uses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(final)
    if not ordered:
        return final
    recursive = re.match(r"\s*WITH\s+RECURSIVE\b", final)
    views = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered)
    own = recursive or re.match(r"\s*WITH\b", final)
    return f"{views},\n{final[own.end():]}" if own else f"{views}\n{final}"


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLE.items()}


def pick(index: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


ROI = ("L_AG", "R_AG", "L_IFGtri", "L_Heschl", "R_Heschl", "L_pSTG")
FAMILY = ("SEMANTIC", "SEMANTIC", "SEMANTIC", "AUDITORY", "AUDITORY", "AUDITORY")
CONDITIONS = ("acoustic_only", "full", "mismatched_shared", "raw", "shared", "specific")

VIEWS["v_subject_results"] = f"""
SELECT 'S' || l_suppkey AS subject_id, CASE l_returnflag WHEN 'A' THEN 'EN' WHEN 'N' THEN 'FR' ELSE 'ZH' END AS language,
  CASE l_linestatus WHEN 'O' THEN 'xlmr' ELSE 'nllb' END AS model, CAST(l_linenumber % 2 AS INTEGER) AS block,
  {pick('(l_orderkey // 2) % 4', 'ATTN', 'POST_ATTN', 'FFN', 'OUTPUT')} AS state,
  {pick('l_orderkey % 2', 'SHARED', 'SPECIFIC')} AS condition,
  {pick('l_partkey % 6', *ROI)} AS roi, {pick('l_partkey % 6', *FAMILY)} AS roi_family,
  avg(10e0 * l_discount - 5e0 * l_tax) AS z_mean,
  CAST(any_value(l_linenumber % 2) AS DOUBLE) AS block_depth_norm, tanh(avg(10e0 * l_discount - 5e0 * l_tax)) AS r_mean
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
VIEWS["v_pairs"] = """
SELECT a.subject_id, a.language, a.model, a.block, a.state, a.roi, a.roi_family, a.z_mean AS shared, s.z_mean AS specific,
  a.z_mean - s.z_mean AS delta_z
FROM v_subject_results a JOIN v_subject_results s USING (subject_id, language, model, block, state, roi, roi_family)
WHERE a.condition = 'SHARED' AND s.condition = 'SPECIFIC'"""
VIEWS["v_family"] = """
SELECT subject_id, language, model, roi_family, block, state, avg(delta_z) AS delta_z FROM v_pairs GROUP BY 1, 2, 3, 4, 5, 6"""
VIEWS["v_candidates"] = """
SELECT model, language, roi_family, block, state, avg(delta_z) AS delta_z_mean FROM v_family GROUP BY 1, 2, 3, 4, 5"""
STATE_RANK = "CASE state WHEN 'ATTN' THEN 0 WHEN 'POST_ATTN' THEN 1 WHEN 'FFN' THEN 2 WHEN 'OUTPUT' THEN 3 ELSE 4 END"
VIEWS["v_reps"] = f"""
SELECT model, language, roi_family, block, state, delta_z_mean FROM v_candidates
QUALIFY row_number() OVER (PARTITION BY model, language, roi_family ORDER BY round(delta_z_mean, 10) DESC, block, {STATE_RANK}) = 1"""
VIEWS["v_group"] = """
SELECT language, model, block, block_depth_norm, state, condition, roi, roi_family, avg(z_mean) AS mean_z, avg(r_mean) AS mean_r,
  count(DISTINCT subject_id) AS n_subjects FROM v_subject_results GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
VIEWS["v_group_pairs"] = """
SELECT language, model, roi, roi_family, block, block_depth_norm, state,
  max(mean_z) FILTER (condition = 'SHARED') AS shared, max(mean_z) FILTER (condition = 'SPECIFIC') AS specific,
  regexp_replace(roi, '^[LR]_', '') AS roi_stem FROM v_group GROUP BY 1, 2, 3, 4, 5, 6, 7"""
VIEWS["v_group_deltas"] = "SELECT *, shared - specific AS delta_z_mean FROM v_group_pairs"

ORACLE["group_results"] = f"""
SELECT language, model, block, block_depth_norm, state, condition, roi, roi_family, {rs('mean_z', 'mean_r')},
  CAST(NULL AS DOUBLE) AS ci_low, CAST(NULL AS DOUBLE) AS ci_high, n_subjects FROM v_group"""
ORACLE["region_deltas"] = f"SELECT subject_id, language, model, block, state, roi, roi_family, {rs('shared', 'specific', 'delta_z')} FROM v_pairs"
ORACLE["subject_family_deltas"] = f"SELECT subject_id, language, model, roi_family, block, state, {rs('delta_z')} FROM v_family"
REP_NOTES = "'ties broken toward shallower block then state order ATTN, POST_ATTN, FFN, OUTPUT' AS tie_break_notes"
ORACLE["representative_states"] = f"""
SELECT model, language, roi_family, block, state, 'max_mean_subject_shared_minus_specific' AS selection_metric, {rs('delta_z_mean')},
  'subject' AS source_level, {REP_NOTES} FROM v_reps"""
ORACLE["representative_states_group_level"] = f"""
SELECT model, language, roi_family, block, state, 'max_mean_subject_shared_minus_specific' AS selection_metric, {rs('delta_z_mean')},
  'group' AS source_level, {REP_NOTES}
FROM (SELECT model, language, roi_family, block, state, avg(shared - specific) AS delta_z_mean FROM v_group_pairs GROUP BY 1, 2, 3, 4, 5)
QUALIFY row_number() OVER (PARTITION BY model, language, roi_family ORDER BY round(delta_z_mean, 10) DESC NULLS LAST, block, {STATE_RANK}) = 1"""
VIEWS["v_layer_source"] = """
SELECT language, model, roi_family, mean_z, roi AS roi_name, block AS layer_index, block_depth_norm AS layer_depth, lower(condition) AS condition
FROM v_group WHERE state = 'OUTPUT'"""
ORACLE["representative_layers"] = f"""
SELECT model, language, roi_family, layer_index AS block, layer_depth AS block_depth_norm, 'OUTPUT' AS state,
  'max_group_mean_shared_minus_specific' AS selection_metric, {r('d', 'delta_z_mean')}, 'ties broken toward shallower layer' AS tie_break_notes
FROM (SELECT model, language, roi_family, layer_index, layer_depth,
  avg(mean_z) FILTER (condition = 'shared') - avg(mean_z) FILTER (condition = 'specific') AS d FROM v_layer_source GROUP BY 1, 2, 3, 4, 5)
QUALIFY row_number() OVER (PARTITION BY model, language, roi_family ORDER BY round(d, 10) DESC NULLS LAST, layer_index) = 1"""
ORACLE["complete_layer_grid"] = ORACLE["representative_layers"]
ORACLE["prioritised_group_tables"] = f"""
SELECT language, model, roi_family, {rs('mean_z')}, roi_name, layer_index, layer_depth, condition, source_priority FROM (
  SELECT language, model, roi_family, mean_z, roi_name, layer_index, layer_depth, condition, 0 AS source_priority FROM v_layer_source
  UNION ALL
  SELECT upper(language), model, upper(roi_family), avg(value), roi_name, layer_index, layer_depth, condition, 1 FROM v_metrics
  WHERE metric_name = 'z' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY language, model, roi_name, roi_family, layer_index, condition ORDER BY source_priority DESC) = 1"""
ORACLE["group_region_deltas"] = f"""
SELECT language, model, roi, roi_family, block, block_depth_norm, state, {rs('shared', 'specific', 'delta_z_mean')}, roi_stem FROM v_group_deltas"""

# ------------------------------------------------------------------ manifests
VIEWS["v_runs"] = """
SELECT 'C' || o_custkey AS subject_id, CASE o_custkey % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' WHEN 2 THEN 'ZH' END AS language,
  o_orderpriority AS task_name, 'run-' || o_orderkey AS raw_run_label, CAST(month(o_orderdate) % 9 + 1 AS INTEGER) AS canonical_run,
  CAST(month(o_orderdate) % 9 + 1 AS INTEGER) AS story_section, CAST(floor(o_totalprice / 1000) AS INTEGER) AS n_trs, 'MNI' AS space,
  CASE WHEN o_orderkey % 2 = 0 THEN '/abs/' ELSE 'rel/' END || o_orderkey AS prior_relative_bold_path,
  CASE WHEN o_orderkey % 2 = 0 THEN '/abs/' ELSE '/data/rel/' END || o_orderkey AS bold_path,
  o_orderstatus = 'F' AS valid_preproc_bold, floor(o_totalprice / 1000) > 0 AS valid_n_trs,
  o_orderstatus = 'F' AND floor(o_totalprice / 1000) > 0 AS is_valid
FROM orders"""
VIEWS["v_rois"] = """
SELECT 'C' || o_custkey AS subject_id, CASE o_custkey % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' WHEN 2 THEN 'ZH' END AS language,
  CAST(month(o_orderdate) % 9 + 1 AS INTEGER) AS canonical_run, 'roi/' || o_orderkey AS roi_timeseries_path,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS n_scans, 18 AS n_rois
FROM orders WHERE o_custkey % 4 < 3"""
VIEWS["v_sample0"] = """
SELECT coalesce(a.language, z.language) AS language, coalesce(a.subject_id, z.subject_id) AS subject_id,
  coalesce(n_canonical_runs, 0) AS n_canonical_runs, coalesce(all_runs_valid, false) AS all_runs_valid, coalesce(n_trs_total, 0) AS n_trs_total,
  coalesce(n_roi_runs, 0) AS n_roi_runs, coalesce(n_rois_observed, 0) AS n_rois_observed, coalesce(n_scans_total, 0) AS n_scans_total
FROM (SELECT language, subject_id, count(DISTINCT canonical_run) AS n_canonical_runs, bool_and(is_valid) AS all_runs_valid,
        CAST(sum(n_trs) AS BIGINT) AS n_trs_total FROM v_runs WHERE language IS NOT NULL GROUP BY 1, 2) a
FULL JOIN (SELECT language, subject_id, count(DISTINCT canonical_run) AS n_roi_runs, CAST(max(n_rois) AS BIGINT) AS n_rois_observed,
        CAST(sum(n_scans) AS BIGINT) AS n_scans_total FROM v_rois GROUP BY 1, 2) z
ON a.language = z.language AND a.subject_id = z.subject_id"""
VIEWS["v_sample"] = """
SELECT *, CASE WHEN included THEN '' ELSE concat_ws(';',
  CASE WHEN n_canonical_runs <> 4 THEN 'canonical_runs=' || n_canonical_runs END,
  CASE WHEN n_roi_runs <> 4 THEN 'roi_runs=' || n_roi_runs END,
  CASE WHEN NOT all_runs_valid THEN 'invalid_run_manifest_rows' END,
  CASE WHEN n_rois_observed <= 0 THEN 'missing_roi_targets' END) END AS exclusion_reason
FROM (SELECT *, n_canonical_runs = 4 AND n_roi_runs = 4 AND all_runs_valid AND n_rois_observed > 0 AS included FROM v_sample0)"""
ORACLE["run_manifest"] = "SELECT * FROM v_runs"
ORACLE["roi_manifest_union"] = "SELECT * FROM v_rois"
ORACLE["sample_manifest"] = "SELECT * FROM v_sample"
ORACLE["included_subject_counts"] = "SELECT language, count(DISTINCT subject_id) AS n_subjects FROM v_sample WHERE included GROUP BY 1"
ORACLE["table1_sample_summary"] = f"""
SELECT p.language, n_subjects, n_runs, {r('coalesce(d.m, 0e0)', 'mean_duration')}, 2e0 AS "TR", coalesce(reasons, 'none') AS any_exclusions
FROM (SELECT language, count(DISTINCT subject_id) FILTER (included) AS n_subjects,
    coalesce(max(n_canonical_runs) FILTER (included), 0) AS n_runs,
    string_agg(DISTINCT exclusion_reason, '; ' ORDER BY exclusion_reason) FILTER (NOT included AND exclusion_reason <> '') AS reasons
  FROM v_sample GROUP BY 1) p
LEFT JOIN (SELECT language, avg(n_scans) * 2e0 AS m FROM v_rois WHERE (language, subject_id) IN (SELECT (language, subject_id) FROM v_sample WHERE included) GROUP BY 1) d
ON p.language = d.language"""
ORACLE["run_scan_conflicts"] = """
SELECT language, canonical_run, min(n_scans) AS low, max(n_scans) AS high FROM v_rois GROUP BY 1, 2 HAVING min(n_scans) <> max(n_scans)"""
ORACLE["missing_subject_runs"] = """
SELECT language, subject_id, canonical_run FROM (SELECT DISTINCT language, subject_id FROM v_runs WHERE language IS NOT NULL)
CROSS JOIN (SELECT DISTINCT canonical_run FROM v_runs WHERE language IS NOT NULL)
EXCEPT SELECT language, subject_id, canonical_run FROM v_runs"""
ORACLE["sentence_spans"] = f"""
SELECT 'EN' AS language, l_linenumber AS story_section, l_linenumber AS canonical_run, CAST(l_orderkey AS INTEGER) AS section_local_sentence_id,
  CAST(l_partkey AS INTEGER) AS global_sentence_id, l_returnflag || l_linestatus AS text, {r('l_quantity', 'onset_sec')},
  {r('l_quantity + l_tax', 'offset_sec')}, {r('l_tax', 'duration_sec')}, 1 AS merge_size,
  '{{"first_word_idx": ' || l_suppkey || ', "last_word_idx": ' || (l_suppkey + l_linenumber) || '}}' AS source_annotation_ids,
  CASE WHEN l_discount = 0 THEN 'ok' ELSE 'alignment_cost_nonzero' END AS quality_flag, l_linenumber AS n_words,
  CAST(l_suppkey AS INTEGER) AS first_word_idx, CAST(l_suppkey + l_linenumber AS INTEGER) AS last_word_idx, {r('l_discount', 'alignment_cost')}
FROM lineitem"""
VIEWS["v_qc"] = """
SELECT l_orderkey AS triplet_id, min(l_suppkey) % 9 + 1 AS section_index, max(l_returnflag) = 'R' AS needs_manual_review,
  CASE WHEN min(l_linestatus) = 'O' THEN 'approved' WHEN max(l_linestatus) = 'F' THEN 'rejected' END AS manual_status,
  CASE WHEN max(l_discount) > 0.05e0 THEN 'n' || count(*) END AS notes FROM lineitem GROUP BY 1"""


def _triplet_columns() -> str:
    out = []
    for i, lang in enumerate(("en", "fr", "zh")):
        low, high = f"o_custkey + {i}", f"o_custkey + {i} + o_orderkey % 3"
        out.append(
            f"'{lang} ' || o_orderpriority AS {lang}_text, '[' || array_to_string(range({low}, {high} + 1), ', ') || ']' AS {lang}_sentence_ids, "
            + r(f"o_totalprice / 1000 + {i}", f"{lang}_onset_sec") + ", " + r(f"o_totalprice / 1000 + {i} + 2", f"{lang}_offset_sec")
        )
    return ", ".join(out)


ORACLE["triplets_with_qc"] = f"""
SELECT o_orderkey AS triplet_id, CAST(o_custkey % 9 + 1 AS INTEGER) AS story_section, CAST(o_custkey % 9 + 1 AS INTEGER) AS canonical_run,
  CAST(o_custkey AS INTEGER) AS section_local_triplet_id, o_orderstatus AS merge_pattern, coalesce(needs_manual_review, false) AS review_flag,
  coalesce(manual_status, 'approved') <> 'approved' AS repair_flag, coalesce(manual_status, 'missing') AS qc_manual_status,
  coalesce(notes, '') AS qc_notes, {_triplet_columns()}
FROM orders LEFT JOIN v_qc ON o_orderkey = triplet_id AND o_custkey % 9 + 1 = section_index"""
VIEWS["v_metrics"] = f"""
SELECT 'S' || l_suppkey AS subject_id, {pick('l_orderkey % 3', 'en', 'fr', 'zh')} AS language,
  CASE l_linestatus WHEN 'O' THEN 'xlmr' ELSE 'nllb_encoder' END AS model, {pick('l_partkey % 6', *ROI)} AS roi_name,
  lower({pick('l_partkey % 6', *FAMILY)}) AS roi_family, CAST(l_linenumber % 2 AS INTEGER) AS layer_index,
  CAST(l_linenumber % 2 AS DOUBLE) AS layer_depth, {pick('l_suppkey % 6', *CONDITIONS)} AS condition,
  {pick('l_linenumber % 3', 'r', 'z', 'r2')} AS metric_name, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9"""
STATUS = """CASE WHEN model = 'nllb' AND condition = 'MISMATCHED_SHARED' THEN 'refresh_required_dense_nllb_and_20_shuffle_mismatch'
  WHEN model = 'nllb' THEN 'refresh_required_dense_nllb' WHEN condition = 'MISMATCHED_SHARED' THEN 'refresh_required_20_shuffle_mismatch'
  ELSE 'reusable_bridge_reference' END"""
VIEWS["v_bridge"] = f"""
SELECT *, {STATUS} AS legacy_status, 'prior_paper_release' AS source_release FROM (
  SELECT subject_id, upper(language) AS language, replace(model, '_encoder', '') AS model, layer_index AS block, layer_depth AS block_depth_norm,
    'OUTPUT' AS state, upper(condition) AS condition, roi_name AS roi, upper(roi_family) AS roi_family,
    max(value) FILTER (metric_name = 'r') AS r_mean, max(value) FILTER (metric_name = 'z') AS z_mean, max(value) FILTER (metric_name = 'r2') AS r2_mean
  FROM v_metrics GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9)"""
ORACLE["subject_bridge"] = f"""
SELECT subject_id, language, model, block, block_depth_norm, state, condition, roi, roi_family, {rs('r_mean', 'z_mean', 'r2_mean')},
  legacy_status, source_release FROM v_bridge"""
VIEWS["v_features0"] = f"""
SELECT CASE l_linestatus WHEN 'O' THEN 'xlmr' ELSE 'nllb_encoder' END AS model, {pick('l_orderkey % 3', 'en', 'fr', 'zh')} AS language,
  l_linenumber AS layer_index, {pick('l_suppkey % 6', *CONDITIONS)} AS condition,
  CASE WHEN l_suppkey % 6 = 2 THEN l_partkey % 20 END AS shuffle_index, CAST(count(*) AS INTEGER) AS n_rows FROM lineitem GROUP BY 1, 2, 3, 4, 5"""
ORACLE["bridge_coverage"] = """
SELECT model, language, condition, count(DISTINCT block) AS layer_count, min(block) AS layer_min, max(block) AS layer_max,
  count(DISTINCT subject_id) AS n_subjects, count(DISTINCT roi) AS n_rois, min(legacy_status) AS legacy_status,
  any_value(s.n) AS legacy_mismatch_shuffle_count,
  CASE WHEN min(legacy_status) = 'reusable_bridge_reference' THEN 'reference_and_schema_bridge' ELSE 'reference_only_until_local_refresh' END AS bridge_use
FROM v_bridge, (SELECT coalesce(max(shuffle_index) + 1, 0) AS n FROM v_features0 WHERE condition = 'mismatched_shared') s GROUP BY 1, 2, 3"""
ORACLE["output_feature_manifest"] = f"""
SELECT replace(model, '_encoder', '') AS model, upper(language) AS target_language, layer_index AS block,
  {r('CAST(layer_index AS DOUBLE) / (SELECT greatest(1, max(layer_index)) FROM v_features0)', 'block_depth_norm')}, 'OUTPUT' AS state,
  upper(condition) AS condition, shuffle_index, 64 AS feature_dim, n_rows FROM v_features0"""

ORACLE["group_bridge"] = f"""
SELECT language, model, block, block_depth_norm, state, condition, roi, roi_family, {rs('mean_z', 'mean_r', 'mean_r2', 'se_z')}, n_subjects, legacy_status, source_release
FROM (SELECT language, model, block, block_depth_norm, state, condition, roi, roi_family, legacy_status, source_release, avg(z_mean) AS mean_z, avg(r_mean) AS mean_r,
  avg(r2_mean) AS mean_r2, stddev_samp(z_mean) / sqrt(count(z_mean)) AS se_z, count(DISTINCT subject_id) AS n_subjects FROM v_bridge GROUP BY ALL)"""
ORACLE["output_state_manifest"] = f"""
SELECT CASE WHEN vec_id % 2 = 0 THEN 'xlmr' ELSE 'nllb' END AS model, {pick('vec_id % 3', 'EN', 'FR', 'ZH')} AS language, CAST(vec_id // 6 % 4 AS INTEGER) AS block,
  {r('CAST(vec_id // 6 % 4 AS DOUBLE) / 3', 'block_depth_norm')}, 'OUTPUT' AS state, CAST(count(*) AS INTEGER) AS n_rows, CAST(len(embedding) AS INTEGER) AS hidden_size, 'float32' AS dtype
FROM embeddings GROUP BY ALL"""

# ------------------------------------------------------------------ inference
VIEWS["v_contrasts"] = """
SELECT model, language, hypothesis, subject_id, avg(delta_z) FILTER (pos) AS positive_mean, avg(delta_z) FILTER (NOT pos) AS negative_mean,
  avg(delta_z) FILTER (pos) - avg(delta_z) FILTER (NOT pos) AS effect_value
FROM (SELECT *, CASE roi_family WHEN 'SEMANTIC' THEN 'H1_semantic_ffn_preference' ELSE 'H2_auditory_attention_preference' END AS hypothesis,
  (roi_family = 'SEMANTIC') = (state IN ('FFN', 'OUTPUT')) AS pos FROM v_family)
GROUP BY 1, 2, 3, 4 HAVING avg(delta_z) FILTER (pos) IS NOT NULL AND avg(delta_z) FILTER (NOT pos) IS NOT NULL"""
VIEWS["v_summary"] = """
SELECT model, language, hypothesis, avg(effect_value) AS effect_mean, count(*) AS n_subjects, coalesce(stddev_samp(effect_value), 0) AS sd
FROM v_contrasts GROUP BY 1, 2, 3"""
VIEWS["v_flips"] = """
SELECT model, language, hypothesis, hb * 32 + pos - 1 AS draw,
  avg(CASE WHEN substr(md5('1337|' || model || '|' || language || '|' || hypothesis || '|perm|' || subject_id || '|' || hb), pos, 1) >= '8' THEN 1e0 ELSE -1e0 END * effect_value) AS permuted_mean
FROM v_contrasts, (SELECT unnest(range(313)) AS hb), (SELECT unnest(range(1, 33)) AS pos) WHERE hb * 32 + pos - 1 < 10000 GROUP BY 1, 2, 3, 4"""
VIEWS["v_signflip"] = """
SELECT model, language, hypothesis, any_value(effect_mean) AS observed_mean, avg(permuted_mean) AS permuted_mean, stddev_samp(permuted_mean) AS permuted_std,
  (1 + count(*) FILTER (round(permuted_mean, 12) >= round(effect_mean, 12))) / 10001e0 AS p_raw, any_value(n_subjects) AS n_subjects
FROM v_flips JOIN v_summary USING (model, language, hypothesis) GROUP BY 1, 2, 3"""
VIEWS["v_slots"] = """
SELECT model, language, hypothesis, effect_value,
  row_number() OVER (PARTITION BY model, language, hypothesis ORDER BY substr(md5(subject_id), 1, 2), subject_id) - 1 AS slot,
  count(*) OVER (PARTITION BY model, language, hypothesis) AS n FROM v_contrasts"""
VIEWS["v_boot"] = """
SELECT model, language, hypothesis, draw, avg(s.effect_value) AS sample_mean FROM (
  SELECT model, language, hypothesis, draw,
    ('0x' || substr(md5('1337|' || model || '|' || language || '|' || hypothesis || '|boot|' || draw || '|' || slot // 4), 8 * (slot % 4) + 1, 8))::BIGINT % n AS pick
  FROM v_slots, (SELECT unnest(range(10000)) AS draw)) p JOIN v_slots s USING (model, language, hypothesis)
WHERE s.slot = p.pick GROUP BY 1, 2, 3, 4"""
VIEWS["v_interval"] = """
SELECT model, language, hypothesis, quantile_cont(sample_mean, 0.025e0) AS ci_low, quantile_cont(sample_mean, 0.975e0) AS ci_high,
  avg(sample_mean) AS bootstrap_mean, stddev_samp(sample_mean) AS bootstrap_std FROM v_boot GROUP BY 1, 2, 3"""
VIEWS["v_primary"] = """
SELECT *, least(1e0, max(step) OVER (ORDER BY p_raw, model, language, hypothesis ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (
  SELECT model, language, hypothesis, effect_mean, ci_low, ci_high, p_raw, v_summary.n_subjects AS n_subjects, sd,
    p_raw * (count(*) OVER () - row_number() OVER (ORDER BY p_raw, model, language, hypothesis) + 1) AS step
  FROM v_summary JOIN v_signflip USING (model, language, hypothesis) JOIN v_interval USING (model, language, hypothesis))"""
CELL = "model, language, hypothesis"
ORACLE["hypothesis_contrasts"] = f"SELECT {CELL}, subject_id, {rs('positive_mean', 'negative_mean', 'effect_value')} FROM v_contrasts"
ORACLE["contrast_summary"] = f"""
SELECT {CELL}, {rs('effect_mean')}, n_subjects, {r('sd / sqrt(n_subjects)', 'se')}, {r('CASE WHEN sd > 0 THEN effect_mean / sd ELSE 0 END', 'dz')} FROM v_summary"""
ORACLE["sign_flip_tests"] = f"SELECT {CELL}, {rs('observed_mean', 'permuted_mean', 'permuted_std', 'p_raw')}, n_subjects FROM v_signflip"
ORACLE["bootstrap_intervals"] = f"""
SELECT {CELL}, {rs('ci_low', 'ci_high', 'bootstrap_mean', 'bootstrap_std')}, n_subjects FROM v_interval JOIN v_summary USING ({CELL})"""
ORACLE["primary_effects"] = f"""
SELECT {CELL}, {rs('effect_mean', 'ci_low', 'ci_high', 'p_raw', 'p_holm')}, n_subjects, 10000::BIGINT AS permutation_count, 10000::BIGINT AS bootstrap_count,
  {r('sd / sqrt(n_subjects)', 'se')}, {r('CASE WHEN sd > 0 THEN effect_mean / sd ELSE 0 END', 'dz')} FROM v_primary"""
ORACLE["table3_confirmatory"] = f"""
SELECT {CELL}, {rs('effect_mean', 'ci_low', 'ci_high', 'p_raw', 'p_holm')}, n_subjects, 10000::BIGINT AS permutation_count, 10000::BIGINT AS bootstrap_count FROM v_primary"""
ORACLE["scoped_results"] = """
SELECT model, language, state, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM v_subject_results WHERE language IN ('EN', 'FR') AND state = 'FFN' GROUP BY 1, 2, 3"""
ORACLE["primary_coverage"] = f"""
WITH want AS (SELECT model, language, hypothesis FROM (SELECT unnest(['xlmr', 'nllb', 'other']) AS model), (SELECT unnest(['EN', 'FR']) AS language),
  (SELECT unnest(['H1_semantic_ffn_preference', 'H2_auditory_attention_preference']) AS hypothesis)),
seen AS (SELECT DISTINCT {CELL} FROM v_contrasts)
SELECT {CELL}, 'missing' AS gap FROM (FROM want EXCEPT FROM seen) UNION ALL SELECT {CELL}, 'extra' FROM (FROM seen EXCEPT FROM want)"""
ORACLE["holm_by_supplier"] = f"""
SELECT p_partkey, p_brand, {rs('p_raw')}, {r('least(1e0, max(step) OVER (PARTITION BY p_brand ORDER BY p_raw, p_partkey ROWS UNBOUNDED PRECEDING))', 'p_holm')}
FROM (SELECT *, p_raw * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p_raw, p_partkey) + 1) AS step
  FROM (SELECT p_partkey, p_brand, p_retailprice % 100 / 1000 AS p_raw FROM part))"""
ORACLE["seed_offsets"] = """
SELECT p_partkey, CAST(list_sum(list_transform(range(1, length(k) + 1), lambda i: i * ascii(substr(k, i, 1)))) AS BIGINT) % 100000 AS seed_offset
FROM (SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS k FROM part)"""

# ------------------------------------------------------------------ upserts
ORACLE["upsert_by_scope"] = """
WITH p AS (SELECT p_brand, CASE WHEN p_size > 10 THEN p_size END AS scope, p_partkey, p_retailprice FROM part),
inc AS (SELECT p_brand, scope, p_partkey + 1000000 AS p_partkey FROM p WHERE p_retailprice > 1500)
SELECT p_brand, scope, p_partkey FROM p WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.p_brand = p.p_brand AND inc.scope IS NOT DISTINCT FROM p.scope)
UNION ALL SELECT p_brand, scope, p_partkey FROM inc"""
ORACLE["replace_exact_rows"] = f"""
SELECT subject_id, language, model, roi_name, roi_family, layer_index, layer_depth, condition, metric_name,
  {r("CASE WHEN layer_index = 1 AND condition <> 'acoustic_only' THEN value + 1 ELSE value END", 'value')} FROM v_metrics"""
ORACLE["distinct_shard_union"] = "SELECT o_custkey AS triplet_id FROM orders UNION SELECT l_suppkey FROM lineitem"
ORACLE["duplicate_shard_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
ORACLE["stale_table_rows"] = """
WITH expected AS (SELECT o_custkey, o_orderstatus FROM orders),
stored AS (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT *, 'stored' AS side FROM (FROM stored EXCEPT ALL FROM expected) UNION ALL SELECT *, 'expected' FROM (FROM expected EXCEPT ALL FROM stored)"""
ORACLE["pending_work"] = """
SELECT c_custkey, o_orderpriority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)
EXCEPT SELECT o_custkey, o_orderpriority FROM orders"""
ORACLE["shard_language_gaps"] = """
WITH seen AS (SELECT DISTINCT language FROM v_subject_results), want AS (SELECT DISTINCT upper(lang) AS language FROM documents)
SELECT language, 'missing' AS gap FROM (FROM want EXCEPT FROM seen) UNION ALL SELECT language, 'extra' FROM (FROM seen EXCEPT FROM want)"""

# ------------------------------------------------------------------ reports
ORACLE["table4_representative_regions"] = f"""
SELECT g.model, g.language, g.roi_family, g.block AS representative_block, g.state AS representative_state, regexp_replace(roi, '^[LR]_', '') AS roi,
  {r("avg(mean_z) FILTER (condition = 'SHARED')", 'shared_mean_z')}, {r("avg(mean_z) FILTER (condition = 'SPECIFIC')", 'specific_mean_z')},
  {r("avg(mean_z) FILTER (condition = 'SHARED') - avg(mean_z) FILTER (condition = 'SPECIFIC')", 'delta_z_mean')}
FROM v_group g JOIN v_reps p ON g.model = p.model AND g.language = p.language AND g.roi_family = p.roi_family AND g.block = p.block AND g.state = p.state
WHERE (g.roi_family = 'SEMANTIC' AND regexp_replace(roi, '^[LR]_', '') IN ('AG', 'IFGtri'))
   OR (g.roi_family = 'AUDITORY' AND regexp_replace(roi, '^[LR]_', '') IN ('pSTG', 'Heschl')) GROUP BY 1, 2, 3, 4, 5, 6"""
ORACLE["figure2_baseline_deltas"] = f"""
SELECT model, language, roi_family, {r("avg(mean_z) FILTER (condition = 'SHARED') - avg(mean_z) FILTER (condition = 'SPECIFIC')", 'delta_z_mean')}
FROM v_group GROUP BY 1, 2, 3"""
ORACLE["figure3_depth_heatmap"] = f"""
WITH cells AS (SELECT model, language, roi_family, state, block, avg(delta_z_mean) AS d FROM v_group_deltas GROUP BY 1, 2, 3, 4, 5),
blocks AS (SELECT model, language, roi_family, CAST(unnest(range(max(block) + 1)) AS INTEGER) AS block FROM cells GROUP BY 1, 2, 3)
SELECT b.model, b.language, b.roi_family, s.state, b.block, {r('d', 'delta_z_mean')}
FROM blocks b CROSS JOIN (SELECT unnest(['INPUT', 'ATTN', 'POST_ATTN', 'FFN', 'OUTPUT']) AS state) s
LEFT JOIN cells c ON c.model = b.model AND c.language = b.language AND c.roi_family = b.roi_family AND c.state = s.state AND c.block = b.block"""
ORACLE["figure4_primary_panel"] = f"""
SELECT {CELL}, {rs('effect_mean', 'ci_low', 'ci_high')}, p_holm < 0.05e0 AS significant, subject_id, {rs('effect_value')}
FROM v_primary LEFT JOIN v_contrasts USING ({CELL})"""
ORACLE["figure5_region_curves"] = f"""
SELECT roi_stem, state, block_depth_norm, {r('avg(delta_z_mean)', 'delta_z_mean')} FROM v_group_deltas
WHERE roi_stem IN ('AG', 'Heschl', 'IFGtri', 'pSTG') GROUP BY 1, 2, 3"""
ORACLE["figure9_region_preference"] = f"SELECT roi_family, roi, {r('avg(delta_z_mean)', 'delta_z_mean')} FROM v_group_deltas GROUP BY 1, 2"
ORACLE["price_percentiles"] = f"""
SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.025e0)', 'ci_low')}, {r('quantile_cont(l_extendedprice, 0.975e0)', 'ci_high')} FROM lineitem GROUP BY 1"""
