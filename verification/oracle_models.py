"""SQL of the regression, attribution, deletion, status and source queries."""

from __future__ import annotations

from verification.oracle import ORACLE, VIEWS, r, rs
from verification.oracle_vectors import basis, cut_span, encoded

# ------------------------------------------------------------------ regression
VIEWS["v_z"] = "SELECT language, canonical_run, scan, sum(value) AS z, sum(value * value) AS zz FROM v_nuisance GROUP BY 1, 2, 3"
VIEWS["v_xz"] = """
SELECT language, block, condition, canonical_run, scan, 1 + sx + z AS s, 1 + sxx + zz AS ss
FROM (SELECT language, block, condition, canonical_run, scan, sum(x) AS sx, sum(x * x) AS sxx FROM v_design GROUP BY 1, 2, 3, 4, 5)
JOIN v_z USING (language, canonical_run, scan)"""
HEAD = "'m0' AS model, language, block, 'OUTPUT' AS state, condition, canonical_run"
ORACLE["run_gram_blocks"] = f"""
SELECT {HEAD}, {r('count(*)', 'n')}, {r('sum(ss) / 1e6', 'g_trace')}, {r('sum(s * s) / 1e6', 'g_total')} FROM v_xz GROUP BY language, block, condition, canonical_run"""
VIEWS["v_y"] = "SELECT language, canonical_run, scan, sum(value) AS y, sum(value * value) AS yy FROM v_bold GROUP BY 1, 2, 3"
ORACLE["run_cross_blocks"] = f"""
SELECT {HEAD}, 0 AS chunk, {r('coalesce(sum(s * y), 0e0) / 1e6', 'c_total')}, {r('coalesce(sum(yy), 0e0) / 1e6', 'yy_total')}
FROM v_xz LEFT JOIN v_y USING (language, canonical_run, scan) GROUP BY language, block, condition, canonical_run"""
ORACLE["alpha_choice"] = f"""
WITH cells AS (SELECT l_linestatus AS model, l_suppkey AS target_index, l_linenumber AS outer_run, CAST(l_orderkey % 7 + 1 AS INTEGER) AS test_run, max(l_partkey) AS seed
  FROM lineitem GROUP BY 1, 2, 3, 4),
s AS (SELECT *, seed * i % 13 / 20e0 AS r FROM cells, (SELECT unnest(range(1, 16)) AS i)),
m AS (SELECT model, target_index, outer_run, i, round(avg(atanh(r)) FILTER (test_run <> outer_run), 12) AS inner_score, max(r) FILTER (test_run = outer_run) AS fold_r FROM s GROUP BY 1, 2, 3, 4)
SELECT model, outer_run, target_index, {r('pow(10e0, -2 + 8 * (i - 1) / 14e0)', 'alpha')}, {rs('inner_score', 'fold_r')}, {r('atanh(fold_r)', 'fold_z')}
FROM m QUALIFY row_number() OVER (PARTITION BY model, target_index, outer_run ORDER BY inner_score DESC NULLS LAST, i DESC) = 1"""
ORACLE["fold_summary"] = f"""
WITH f AS (SELECT l_linestatus AS model, l_suppkey AS target_index, pow(10e0, -2 + 8 * (l_partkey % 15) / 14e0) AS alpha, l_partkey % 15 AS a,
  l_discount - l_tax AS z, l_quantity AS ys, l_quantity * l_quantity + l_discount AS yq, l_tax * l_quantity AS sse, l_partkey % 20 + 1 AS pcs FROM lineitem),
votes AS (SELECT model, target_index, max(alpha) AS alpha FROM (SELECT model, target_index, a, any_value(alpha) AS alpha, count(*) AS n FROM f GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY model, target_index ORDER BY count(*) DESC, a DESC) = 1) GROUP BY 1, 2)
SELECT f.model, f.target_index, {r('avg(z)', 'z_mean')}, {r('1 - sum(sse) / (sum(yq) - sum(ys) * sum(ys) / count(*))', 'r2_concat')},
  {r('avg(-2 + 8 * a / 14e0)', 'alpha_best_mean_log10')}, {r('avg(pcs)', 'n_pcs_mean')}, count(*) AS n_outer_folds, count(*) AS n_timepoints_total,
  {r('tanh(avg(z))', 'r_mean')}, {r('any_value(votes.alpha)', 'alpha_best_mode')}
FROM f JOIN votes USING (model, target_index) GROUP BY 1, 2"""

# ------------------------------------------------------------------ attribution
ORACLE["token_scope"] = f"""
SELECT model, language, roi_family, block, state, 'max_mean_subject_shared_minus_specific' AS selection_metric, {rs('delta_z_mean')}, 'subject' AS source_level,
  'ties broken toward shallower block then state order ATTN, POST_ATTN, FFN, OUTPUT' AS tie_break_notes, reason AS scope_reason,
  reason IN ('semantic', 'auditory_primary_supported') AS kept
FROM (SELECT p.*, CASE WHEN roi_family = 'SEMANTIC' THEN 'semantic' WHEN e.model IS NULL THEN 'auditory_primary_cell_missing'
    WHEN p_holm >= 0.9e0 THEN 'auditory_primary_not_significant' WHEN effect_mean <= 0 THEN 'auditory_primary_nonpositive' ELSE 'auditory_primary_supported' END AS reason
  FROM v_reps p LEFT JOIN v_primary e ON e.model = p.model AND e.language = p.language AND e.hypothesis = 'H2_auditory_attention_preference')"""
VIEWS["v_w"] = "SELECT CAST(vec_id % 6 + 1 AS INTEGER) AS canonical_run, d % 8 AS d, avg(e) AS w FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY 1, 2"
VIEWS["v_story_basis"] = basis("v_story_rows")
VIEWS["v_story_x"] = """
SELECT b.language, b.canonical_run, b.scan, sum(b.weight * s.v * w.w) AS predicted FROM v_story_basis b
JOIN (SELECT t.target_language, v.triplet_row_index, v.d, avg(v.v) AS v FROM v_targets3 t JOIN v_story_vectors v ON v.language <> t.target_language GROUP BY 1, 2, 3) s
  ON s.target_language = b.language AND s.triplet_row_index = b.triplet_row_index
JOIN v_w w ON w.canonical_run = b.canonical_run AND w.d = s.d GROUP BY 1, 2, 3"""
VIEWS["v_family_sum"] = """
SELECT language, subject_id, roi_family, canonical_run, scan, sum(value) / 2e0 AS value FROM v_bold JOIN v_rois5 USING (roi_index)
WHERE roi_family <> 'CONTROL' GROUP BY 1, 2, 3, 4, 5"""
VIEWS["v_fold_series"] = """
SELECT g.language, p.subject_id, p.roi_family, g.canonical_run, g.scan, coalesce(f.value, 0e0) / 100 AS actual, coalesce(x.predicted, 0e0) AS predicted
FROM v_grid g JOIN (SELECT DISTINCT language, subject_id, roi_family FROM v_target_index JOIN v_rois5 USING (roi_index) WHERE roi_family <> 'CONTROL') p ON p.language = g.language
LEFT JOIN v_family_sum f ON f.language = g.language AND f.subject_id = p.subject_id AND f.roi_family = p.roi_family AND f.canonical_run = g.canonical_run AND f.scan = g.scan
LEFT JOIN v_story_x x ON x.language = g.language AND x.canonical_run = g.canonical_run AND x.scan = g.scan WHERE g.canonical_run <= 6"""
VIEWS["v_window"] = """
SELECT language, canonical_run, triplet_row_index, CAST(scan AS INTEGER) AS scan, coalesce(weight, 0e0) AS weight
FROM (SELECT * FROM v_story_rows, (SELECT unnest(range(480)) AS scan) WHERE scan * 2e0 >= onset_sec + 2e0 AND scan * 2e0 < offset_sec + 12e0)
LEFT JOIN v_story_basis USING (language, canonical_run, triplet_row_index, scan)"""
KEY = "'m0' AS model, language, 0 AS block, 'OUTPUT' AS state, roi_family, subject_id"
ORACLE["window_moments"] = f"""
SELECT {KEY}, canonical_run, triplet_row_index, {r('avg(weight * weight)', 'weight_sq')}, {r('avg(weight * (actual - predicted))', 'weight_error')}
FROM v_window JOIN v_fold_series USING (language, canonical_run, scan) GROUP BY language, roi_family, subject_id, canonical_run, triplet_row_index"""
VIEWS["v_subset_words"] = "FROM v_story_word_texts"
VIEWS["v_mutated"] = f"SELECT triplet_row_index, language, word_index, canonical_run, {cut_span('text', 'word_char_start', 'word_char_end')} AS text FROM v_subset_words"
VIEWS["v_mutated_vectors"] = encoded("v_mutated", "triplet_row_index, language, word_index, canonical_run")
VIEWS["v_word_gain"] = """
SELECT m.triplet_row_index, m.language, m.word_index, sum((m.v - s.v) / 2e0 * w.w) AS g
FROM v_mutated_vectors m JOIN v_story_vectors s ON s.triplet_row_index = m.triplet_row_index AND s.language = m.language AND s.d = m.d
JOIN v_w w ON w.canonical_run = m.canonical_run AND w.d = m.d GROUP BY 1, 2, 3"""
VIEWS["v_word_pieces"] = """
SELECT triplet_row_index, language, word_index, max(i) - min(i) + 1 AS n FROM (
  SELECT triplet_row_index, language, word_index, unnest(range(word_char_start // 4, (word_char_end - 1) // 4 + 1)) AS i FROM v_subset_words) GROUP BY 1, 2, 3"""
VIEWS["v_scores"] = """
SELECT f.language, f.subject_id, f.roi_family, k.canonical_run, k.triplet_row_index, k.language AS sentence_language, k.word_index, k.word_text, k.word_char_start,
  k.word_char_end, k.token_class, CAST(any_value(n.n) AS INTEGER) AS n_subwords_deleted,
  avg(pow(actual - (predicted + weight * g), 2) - pow(actual - predicted, 2)) AS attribution_score
FROM v_subset_words k JOIN v_word_gain g ON g.triplet_row_index = k.triplet_row_index AND g.language = k.language AND g.word_index = k.word_index
JOIN v_word_pieces n ON n.triplet_row_index = k.triplet_row_index AND n.language = k.language AND n.word_index = k.word_index
JOIN v_window x ON x.triplet_row_index = k.triplet_row_index AND x.language <> k.language
JOIN v_fold_series f ON f.language = x.language AND f.canonical_run = x.canonical_run AND f.scan = x.scan GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11"""
ORACLE["word_attributions"] = f"""
SELECT {KEY}, canonical_run, triplet_row_index, sentence_language, word_index, word_text, word_char_start, word_char_end, token_class, n_subwords_deleted,
  {rs('attribution_score')} FROM v_scores"""
VIEWS["v_mass"] = "SELECT language, roi_family, token_class AS class, sum(greatest(attribution_score, 0)) AS mass FROM v_scores GROUP BY 1, 2, 3"
ORACLE["table5_token_class_mass"] = f"""
SELECT 'm0' AS model, language, roi_family, 'SHARED' AS condition, class, {r('mass', 'positive_mass')}, {r("CASE WHEN t > 0 THEN c / t ELSE 0 END", 'content_bias')}
FROM (SELECT *, sum(mass) OVER w AS t, coalesce(sum(mass) FILTER (class = 'CONTENT') OVER w, 0) AS c FROM v_mass WINDOW w AS (PARTITION BY language, roi_family))"""
ORACLE["figure7_class_mass"] = f"SELECT roi_family, class, {r('avg(mass)', 'positive_mass')} FROM v_mass GROUP BY 1, 2"
ORACLE["figure6_examples"] = """
WITH m AS (SELECT language, roi_family, triplet_row_index, avg(greatest(attribution_score, 0)) AS m FROM v_scores GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY roi_family ORDER BY round(avg(greatest(attribution_score, 0)), 10) DESC, language DESC, triplet_row_index DESC) = 1),
s AS (SELECT v.*, max(greatest(attribution_score, 0)) OVER (PARTITION BY v.language, v.roi_family, v.triplet_row_index, sentence_language) AS top
  FROM v_scores v JOIN m ON m.language = v.language AND m.roi_family = v.roi_family AND m.triplet_row_index = v.triplet_row_index)
SELECT 'm0' AS model, s.language AS target_language, roi_family, 0 AS representative_block, 'OUTPUT' AS representative_state, s.triplet_row_index AS triplet_id, sentence_language,
  any_value(x.text) AS text, string_agg(word_text || '(' || CASE WHEN top <= 0 OR attribution_score <= 0 THEN '-' WHEN attribution_score >= 0.75e0 * top THEN '+++'
    WHEN attribution_score >= 0.40e0 * top THEN '++' ELSE '+' END || ')', ' ' ORDER BY word_char_start, word_index, subject_id) AS marked
FROM s JOIN v_story_rows x ON x.triplet_row_index = s.triplet_row_index AND x.language = s.sentence_language GROUP BY s.language, roi_family, s.triplet_row_index, sentence_language"""

# ------------------------------------------------------------------ deletion
GROUP = "language, roi_family, subject_id, triplet_row_index"
WORD = "sentence_language, word_index, word_char_start, word_char_end"
VIEWS["v_ranked"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY {GROUP} ORDER BY round(attribution_score, 10) DESC, sentence_language, word_char_start, word_index) AS INTEGER) AS score_rank FROM v_scores"""
ORACLE["top_words"] = f"SELECT {KEY}, triplet_row_index, {WORD}, score_rank FROM v_ranked WHERE score_rank <= 2"


def plan(ks: str) -> str:
    cell = f"{GROUP}, k"
    return f"""
SELECT *, CASE policy WHEN 'exact_language_token_class_no_overlap' THEN NOT selected
    WHEN 'language_allocation_nonpunct_no_overlap' THEN NOT selected AND (token_class <> 'PUNCT' OR spoken_pool_l < need_l)
    ELSE token_class <> 'PUNCT' OR spoken_l < need_l END AS eligible,
  CAST(CASE WHEN policy = 'exact_language_token_class_no_overlap' THEN need_c ELSE need_l END AS BIGINT) AS need,
  CASE WHEN policy = 'exact_language_token_class_no_overlap' THEN sentence_language || '|' || token_class ELSE sentence_language END AS cell
FROM (SELECT *, CASE WHEN min(CAST(pool_c >= need_c AS INTEGER)) OVER (PARTITION BY {cell}) = 1 THEN 'exact_language_token_class_no_overlap'
    WHEN min(CAST(pool_l >= need_l AS INTEGER)) OVER (PARTITION BY {cell}) = 1 THEN 'language_allocation_nonpunct_no_overlap'
    ELSE 'language_allocation_nonpunct_overlap_allowed' END AS policy
  FROM (SELECT *, count(*) FILTER (selected) OVER c AS need_c, count(*) FILTER (NOT selected) OVER c AS pool_c, count(*) FILTER (selected) OVER l AS need_l,
      count(*) FILTER (NOT selected) OVER l AS pool_l, count(*) FILTER (NOT selected AND token_class <> 'PUNCT') OVER l AS spoken_pool_l,
      count(*) FILTER (token_class <> 'PUNCT') OVER l AS spoken_l
    FROM (SELECT *, score_rank <= k AS selected FROM v_ranked, (SELECT unnest({ks}) AS k))
    WINDOW c AS (PARTITION BY {cell}, sentence_language, token_class), l AS (PARTITION BY {cell}, sentence_language)))"""


VIEWS["v_plan"] = plan("[1, 2]")
ORACLE["matching_plan"] = f"""
SELECT {KEY}, triplet_row_index, k, policy, cell, need, count(*) AS n_words, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (selected) AS n_selected
FROM v_plan GROUP BY language, roi_family, subject_id, triplet_row_index, k, policy, cell, need"""
def sampled(rows: str, draws: int) -> str:
    """One or two words of each cell for every draw; the second is counted among those the first has left."""
    key = f"{GROUP}, k, cell"
    number = lambda i: f"""CAST('0x' || substr(md5('1337|m0|' || language || '|0|OUTPUT|' || roi_family || '|' || subject_id || '|' || triplet_row_index
  || '|' || k || '|' || draw || '|' || cell || '|{i}'), 1, 15) AS BIGINT)"""  # noqa: E731
    return f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {WORD}) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS n FROM ({rows})),
c AS (SELECT *, {number(0)} % n AS one, CASE WHEN need > 1 AND n > 1 THEN {number(1)} % (n - 1) END AS two
  FROM (SELECT DISTINCT {key}, need, n FROM w), (SELECT CAST(unnest(range({draws})) AS INTEGER) AS draw)),
t AS (SELECT {key}, draw, one AS place FROM c UNION ALL SELECT {key}, draw, two + CAST(two >= one AS INTEGER) FROM c WHERE two IS NOT NULL)
SELECT w.*, t.draw FROM t JOIN w USING ({key}, place)"""


VIEWS["v_sampled"] = sampled("SELECT * FROM v_plan WHERE eligible AND need > 0", 100)
ORACLE["sampled_words"] = f"SELECT {KEY}, triplet_row_index, k, draw, {WORD} FROM v_sampled"
TOTAL = f"""
SELECT * FROM (SELECT *, CAST(2 AS INTEGER) AS k, 'all' AS cell, least(2, count(*) OVER g) AS need, count(*) FILTER (score_rank > 2) OVER g AS pool,
  count(*) FILTER (score_rank > 2 AND token_class <> 'PUNCT') OVER g AS spoken FROM v_ranked WINDOW g AS (PARTITION BY {GROUP}))
WHERE pool < need OR (score_rank > 2 AND (token_class <> 'PUNCT' OR spoken < need))"""
ORACLE["total_count_sample"] = f"SELECT {KEY}, triplet_row_index, k, draw, {WORD} FROM ({sampled(TOTAL, 100)})"
CORR = "greatest(-0.999999e0, least(0.999999e0, coalesce(CASE WHEN var_pop({a}) > 0 AND var_pop({p}) > 0 THEN corr({a}, {p}) END, 0e0)))"
VIEWS["v_base_z"] = f"""
SELECT language, roi_family, subject_id, avg(atanh(c)) AS base_z FROM (
  SELECT language, roi_family, subject_id, canonical_run, {CORR.format(a='actual', p='predicted')} AS c FROM v_fold_series GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
ORACLE["base_scores"] = f"SELECT {KEY}, {rs('base_z')} FROM v_base_z"
VIEWS["v_picks"] = f"""
SELECT {GROUP}, canonical_run, k, -1 AS draw, sentence_language, word_char_start AS s, word_char_end AS e FROM v_plan WHERE selected
UNION ALL SELECT {GROUP}, canonical_run, k, draw, sentence_language, word_char_start, word_char_end FROM v_sampled"""
VIEWS["v_requests"] = f"""
SELECT {GROUP}, canonical_run, k, draw, sentence_language, list({{'s': s, 'e': e}} ORDER BY s DESC) AS sp FROM v_picks GROUP BY ALL"""
# k is at most 2, so at most two cuts from right to left.
VIEWS["v_request_texts"] = f"""
SELECT triplet_row_index, language, sp, canonical_run, CASE WHEN len(sp) > 1 THEN {cut_span('one', 'sp[2].s', 'sp[2].e')} ELSE one END AS text FROM (
  SELECT *, {cut_span('text', 'sp[1].s', 'sp[1].e')} AS one FROM (
    SELECT DISTINCT q.triplet_row_index, q.sentence_language AS language, q.sp, q.canonical_run, x.text
    FROM v_requests q JOIN v_story_rows x ON x.triplet_row_index = q.triplet_row_index AND x.language = q.sentence_language))"""
VIEWS["v_request_vectors"] = encoded("v_request_texts", "triplet_row_index, language, sp, canonical_run")
VIEWS["v_request_gain"] = """
SELECT m.triplet_row_index, m.language, m.sp, sum((m.v - s.v) / 2e0 * w.w) AS g
FROM v_request_vectors m JOIN v_story_vectors s ON s.triplet_row_index = m.triplet_row_index AND s.language = m.language AND s.d = m.d
JOIN v_w w ON w.canonical_run = m.canonical_run AND w.d = m.d GROUP BY 1, 2, 3"""
VIEWS["v_changes"] = """
SELECT q.language, q.roi_family, q.subject_id, q.canonical_run, q.k, q.draw, b.scan, sum(g.g * b.weight) AS change
FROM v_requests q JOIN v_request_gain g ON g.triplet_row_index = q.triplet_row_index AND g.language = q.sentence_language AND g.sp = q.sp
JOIN v_story_basis b ON b.language = q.language AND b.canonical_run = q.canonical_run AND b.triplet_row_index = q.triplet_row_index GROUP BY 1, 2, 3, 4, 5, 6, 7"""
VIEWS["v_mutated_z"] = f"""
WITH cells AS (SELECT f.*, k, draw FROM v_fold_series f, (SELECT unnest([1, 2]) AS k), (SELECT CAST(unnest(range(-1, 100)) AS INTEGER) AS draw)),
moved AS (SELECT cells.*, predicted + coalesce(change, 0) AS moved FROM cells LEFT JOIN v_changes USING (language, roi_family, subject_id, canonical_run, k, draw, scan))
SELECT language, roi_family, subject_id, k, draw, avg(atanh(c)) AS z FROM (
  SELECT language, roi_family, subject_id, canonical_run, k, draw, {CORR.format(a='actual', p='moved')} AS c FROM moved GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5"""
VIEWS["v_deletion"] = """
SELECT language, roi_family, subject_id, k, base_z, topk_z, random_z_mean, base_z - topk_z AS delta_topk, base_z - random_z_mean AS delta_random,
  (base_z - topk_z) - (base_z - random_z_mean) AS delta_diff, matching_policy
FROM (SELECT language, roi_family, subject_id, k, max(z) FILTER (draw < 0) AS topk_z, avg(z) FILTER (draw >= 0) AS random_z_mean FROM v_mutated_z GROUP BY 1, 2, 3, 4)
JOIN v_base_z USING (language, roi_family, subject_id)
JOIN (SELECT language, roi_family, subject_id, k, string_agg(DISTINCT policy, '+' ORDER BY policy) AS matching_policy FROM v_plan WHERE selected GROUP BY 1, 2, 3, 4)
  USING (language, roi_family, subject_id, k)"""
ORACLE["deletion_rows"] = f"""
SELECT subject_id, 'm0' AS model, language, roi_family, 0 AS representative_block, 'OUTPUT' AS representative_state, k,
  {rs('base_z', 'topk_z', 'random_z_mean', 'delta_topk', 'delta_random', 'delta_diff')}, 100 AS n_random_draws, matching_policy FROM v_deletion"""
VIEWS["v_table6"] = """
SELECT 'm0' AS model, language, roi_family, k, avg(delta_topk) AS effect_topk, avg(delta_random) AS effect_random, avg(delta_diff) AS diff,
  quantile_cont(delta_diff, 0.025e0) AS ci_low, quantile_cont(delta_diff, 0.975e0) AS ci_high FROM v_deletion GROUP BY 2, 3, 4"""
ORACLE["table6_deletion"] = f"SELECT model, language, roi_family, k, {rs('effect_topk', 'effect_random', 'diff', 'ci_low', 'ci_high')} FROM v_table6"
ORACLE["figure8_curves"] = f"SELECT roi_family, k, model, language, {rs('effect_topk', 'effect_random')} FROM v_table6"
ORACLE["adaptive_subjects"] = """
SELECT 'S' || l_suppkey AS subject_id, l_linestatus AS model, l_returnflag AS language, 'SEMANTIC' AS roi_family, 0 AS representative_block, 'OUTPUT' AS representative_state
FROM lineitem GROUP BY 1, 2, 3
HAVING max(l_discount - l_tax) FILTER (l_linenumber = 2) - coalesce(max(l_discount - l_tax) FILTER (l_linenumber = 1), 0) > 0.005e0"""

ORACLE["deletion_resume"] = f"""
SELECT 'S' || l_suppkey AS subject_id, l_linestatus AS model, l_returnflag AS language, 'SEMANTIC' AS roi_family, 0 AS representative_block, 'OUTPUT' AS representative_state,
  l_linenumber AS k, l_orderkey AS written_utc, {r('l_discount - l_tax', 'delta_diff')} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linestatus, l_returnflag, l_linenumber ORDER BY l_orderkey DESC, l_discount - l_tax DESC) = 1"""
ORACLE["policy_counts"] = """
SELECT 'm0' AS model, language, 0 AS block, 'OUTPUT' AS state, roi_family, k, policy, count(*) AS n_sentences
FROM (SELECT DISTINCT language, roi_family, subject_id, triplet_row_index, k, policy FROM v_plan WHERE selected) GROUP BY language, roi_family, k, policy"""

# ------------------------------------------------------------------ status
VIEWS["v_keyed"] = """
SELECT c_custkey, n_name AS language, c_mktsegment AS roi_family, CAST(c_custkey % 8 AS INTEGER) AS block FROM customer JOIN nation ON n_nationkey = c_nationkey"""
VIEWS["v_placed"] = "SELECT * FROM orders JOIN v_keyed ON o_custkey = c_custkey"
VIEWS["v_documents"] = """
SELECT language, roi_family, block, max(CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'Completed ' ELSE 'failed' END) AS status,
  count(DISTINCT o_custkey) AS total, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS done, count(*) AS written, max(CAST(o_custkey AS VARCHAR)) AS current
FROM v_placed GROUP BY 1, 2, 3"""
VIEWS["v_status"] = """
SELECT s.language, s.roi_family, s.block, coalesce(status, 'not_started') AS status,
  CASE lower(trim(coalesce(status, 'not_started'))) WHEN 'completed' THEN 'completed' WHEN 'running' THEN 'running' WHEN 'failed' THEN 'failed' ELSE 'not_started' END AS status_bucket,
  coalesce(total, n) AS total, coalesce(done, 0) AS done, coalesce(written, 0) AS written, CASE WHEN status IS NULL THEN 0 ELSE 1 END AS resumed, current, stamp, event
FROM (SELECT DISTINCT language, roi_family, block FROM v_keyed) s JOIN (SELECT language, count(DISTINCT c_custkey) AS n FROM v_keyed GROUP BY 1) USING (language)
LEFT JOIN v_documents d ON d.language = s.language AND d.roi_family = s.roi_family AND d.block = s.block
LEFT JOIN (SELECT language, roi_family, block, strftime(o_orderdate, '%Y-%m-%d') AS stamp, o_orderpriority AS event FROM v_placed
  QUALIFY row_number() OVER (PARTITION BY language, roi_family, block ORDER BY o_orderdate::DATE DESC, o_orderpriority DESC) = 1) e
  ON e.language = s.language AND e.roi_family = s.roi_family AND e.block = s.block"""
ORACLE["deletion_status"] = f"""
SELECT 'm0' AS model, language, roi_family, block, 'OUTPUT' AS state, status, status_bucket, total AS subject_ids_total, done AS completed_subjects,
  greatest(0, total - done) AS pending_subjects, written AS rows_written, total * 2 AS expected_k_slots,
  {r('CASE WHEN total > 0 THEN written / (total * 2) ELSE 0 END', 'progress_ratio')}, CAST(resumed AS BIGINT) AS resume_count, current AS current_subject_id,
  stamp AS last_updated_utc, event AS last_event, stamp AS last_event_utc FROM v_status"""
ORACLE["deletion_totals"] = f"""
SELECT count(*) AS settings_total, {', '.join(f"count(*) FILTER (status_bucket = '{b}') AS settings_{b}" for b in ('completed', 'running', 'interrupted', 'failed', 'not_started'))},
  CAST(sum(written) AS BIGINT) AS rows_written_total, CAST(sum(total * 2) AS BIGINT) AS expected_k_slots_total, CAST(sum(done) AS BIGINT) AS completed_subjects_total,
  CAST(sum(total) AS BIGINT) AS subject_ids_total, {r('sum(written) / sum(total * 2)', 'rows_progress_ratio')}, {r('sum(done) / sum(total)', 'subject_progress_ratio')},
  max(stamp) AS last_event_utc, arg_max(event, stamp || event) AS last_event FROM v_status"""
ORACLE["next_settings"] = """
SELECT 'm0' AS model, language, roi_family, block, 'OUTPUT' AS state FROM v_status WHERE status_bucket = 'not_started' ORDER BY language, roi_family, block LIMIT 5"""
ORACLE["status_buckets"] = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'not_started' END AS bucket, count(*) AS n FROM orders GROUP BY 1"""

# ------------------------------------------------------------------ sources and sinks
ORACLE["pruned_parquet_scan"] = f"SELECT event_type, {r('sum(value)', 'value')}, count(*) AS n FROM events GROUP BY 1"
ORACLE["csv_round_trip"] = "FROM labels"
ORACLE["npy_round_trip"] = f"""
SELECT language, block, triplet_row_index // 4 AS row_index, CAST(dim AS INTEGER) AS dim, {r('value')}
FROM (SELECT *, unnest(vec) AS value, unnest(range(len(vec))) AS dim FROM v_states)"""
ORACLE["vector_table_round_trip"] = """
SELECT model, language, block, state, count(*) AS n_rows, CAST(max(len(vec)) AS INTEGER) AS feature_dim, CAST(sum(len(vec)) * 4 AS BIGINT) AS payload_bytes FROM v_states GROUP BY 1, 2, 3, 4"""
ORACLE["sorted_parquet_round_trip"] = f"SELECT o_custkey, count(*) AS n, {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1"
ORACLE["event_log_round_trip"] = """
SELECT user_id, printf('%012d', max(event_id)) AS last_event_utc, arg_max(event_type, event_id) AS last_event FROM events GROUP BY 1"""
ORACLE["tagged_shards"] = "SELECT language AS shard_tag, language, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM v_subject_results GROUP BY 1, 2"
