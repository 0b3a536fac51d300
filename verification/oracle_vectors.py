"""SQL of the vector, text and design queries."""

from __future__ import annotations

from verification.constants import EN_FUNCTION_WORDS, FR_FUNCTION_WORDS, response_kernel
from verification.oracle import ORACLE, VIEWS, r, rs

KERNEL = "[" + ", ".join(repr(v) for v in response_kernel(10.0)) + "]::DOUBLE[]"

# ------------------------------------------------------------------ vectors
VIEWS["v_states"] = """
SELECT 'm0' AS model, CASE vec_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'ZH' END AS language, 'OUTPUT' AS state,
  CAST((vec_id // 3) % 4 AS INTEGER) AS block, vec_id // 3 AS triplet_row_index, embedding::DOUBLE[] AS vec FROM embeddings"""
VIEWS["v_targets3"] = "SELECT unnest(['EN', 'FR', 'ZH']) AS target_language"
VIEWS["v_shared"] = """
SELECT t.target_language, a.block, a.triplet_row_index, a.vec AS first_vec, z.vec AS second_vec,
  list_transform(list_zip(a.vec, z.vec), lambda p: (p[1] + p[2]) / 2e0) AS shared
FROM v_targets3 t JOIN v_states a ON a.language = CASE t.target_language WHEN 'EN' THEN 'FR' ELSE 'EN' END
JOIN v_states z ON z.triplet_row_index = a.triplet_row_index AND z.language = CASE t.target_language WHEN 'ZH' THEN 'FR' ELSE 'ZH' END"""
VIEWS["v_specific"] = """
SELECT target_language, block, triplet_row_index, shared, raw,
  list_transform(list_zip(gap, shared), lambda p: p[1] - factor * p[2]) AS specific
FROM (SELECT *, list_dot_product(shared, gap) / (list_dot_product(shared, shared) + 1e-8) AS factor FROM (
  SELECT h.target_language, h.block, h.triplet_row_index, h.shared, s.vec AS raw,
    list_transform(list_zip(s.vec, h.shared), lambda p: p[1] - p[2]) AS gap
  FROM v_shared h JOIN v_states s ON s.triplet_row_index = h.triplet_row_index AND s.language = h.target_language))"""
VIEWS["v_features"] = """
SELECT 'm0' AS model, block, 'OUTPUT' AS state, target_language, triplet_row_index, 'SHARED' AS condition, shared AS vec FROM v_shared
UNION ALL SELECT 'm0', block, 'OUTPUT', target_language, triplet_row_index, 'SPECIFIC', specific FROM v_specific
UNION ALL SELECT 'm0', block, 'OUTPUT', language, triplet_row_index, 'RAW', vec FROM v_states"""
ORACLE["shared_specific_features"] = f"""
WITH f AS (FROM v_features UNION ALL SELECT 'm0', block, 'OUTPUT', target_language, triplet_row_index, 'FULL', list_concat(shared, specific) FROM v_specific)
SELECT model, block, state, target_language, triplet_row_index, condition, CAST(dim AS INTEGER) AS dim, {r('value', 'value')}
FROM (SELECT *, unnest(vec) AS value, unnest(range(len(vec))) AS dim FROM f)"""
ORACLE["orthogonality_qc"] = f"""
SELECT 'm0' AS model, target_language, block, 'OUTPUT' AS state, count(*) AS row_count,
  {r('avg(list_dot_product(shared, specific))', 'shared_specific_dot_mean')}, {r('max(abs(list_dot_product(shared, specific)))', 'shared_specific_dot_abs_max')},
  {r('avg(sqrt(list_dot_product(shared, shared)))', 'shared_norm_mean')}, {r('avg(sqrt(list_dot_product(specific, specific)))', 'specific_norm_mean')}
FROM v_specific GROUP BY 2, 3"""
ORACLE["vector_group_shapes"] = """
SELECT model, block, state, count(*) AS n_languages, min(n) AS min_rows, max(n) AS max_rows, CAST(min(lo) AS INTEGER) AS min_width,
  CAST(max(hi) AS INTEGER) AS max_width, count(*) = 3 AND min(n) = max(n) AND min(lo) = max(hi) AS complete
FROM (SELECT model, block, state, language, count(*) AS n, min(len(vec)) AS lo, max(len(vec)) AS hi FROM v_states GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
UNIT = "list_transform({0}, lambda x: x * (1e0 / greatest(sqrt(list_dot_product({0}, {0})), 1e-8)))"
ORACLE["normalised_vectors"] = f"""
SELECT vec_id, CAST(dim AS INTEGER) AS dim, {r('value')} FROM (
  SELECT vec_id, unnest(u) AS value, unnest(range(len(u))) AS dim FROM (SELECT vec_id, {UNIT.format('v')} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"""
VIEWS["v_diffs"] = f"""
SELECT model, language, block, state, avg(abs(a - z)) AS mean_abs_diff, max(abs(a - z)) AS max_abs_diff FROM (
  SELECT model, language, block, state, unnest(vec) AS a, unnest({UNIT.format('vec')}) AS z FROM v_states) GROUP BY 1, 2, 3, 4"""
ORACLE["output_equivalence"] = f"SELECT model, language, block, state, {rs('mean_abs_diff', 'max_abs_diff')} FROM v_diffs"
ORACLE["table2_model_inventory"] = """
SELECT 'm0' AS model, 64 AS hidden_size, CAST(max(block) + 1 AS BIGINT) AS n_blocks, string_agg(DISTINCT state, ',') AS states_extracted,
  CASE WHEN (SELECT max(max_abs_diff) FROM v_diffs) <= 1e-5 THEN 'PASS' ELSE 'FAIL' END AS output_equivalence,
  printf('%.2f', sum(len(vec)) * 4 / 1048576e0) || ' MB' AS cache_size_summary FROM v_states"""
VIEWS["v_derange"] = """
SELECT language, shuffle_index, canonical_run, triplet_row_index,
  coalesce(lead(triplet_row_index) OVER w, first_value(triplet_row_index) OVER w) AS permuted_row_index
FROM (SELECT *, md5('1337|' || language || '|' || shuffle_index || '|' || canonical_run || '|' || triplet_row_index) AS h
  FROM (SELECT language, block AS canonical_run, triplet_row_index FROM v_states), (SELECT CAST(unnest(range(20)) AS INTEGER) AS shuffle_index))
WINDOW w AS (PARTITION BY language, shuffle_index, canonical_run ORDER BY h, triplet_row_index)"""
ORACLE["run_derangements"] = "FROM v_derange"
ORACLE["mismatched_shared"] = f"""
WITH d AS (SELECT target_language, block, shuffle_index, triplet_row_index,
    coalesce(lead(triplet_row_index) OVER w, first_value(triplet_row_index) OVER w) AS permuted
  FROM (SELECT *, md5('1337|' || target_language || '|' || shuffle_index || '|' || block || '|' || triplet_row_index) AS h
    FROM v_shared, (SELECT CAST(unnest(range(20)) AS INTEGER) AS shuffle_index))
  WINDOW w AS (PARTITION BY target_language, shuffle_index, block ORDER BY h, triplet_row_index))
SELECT 'm0' AS model, d.block, 'OUTPUT' AS state, d.target_language, shuffle_index, d.triplet_row_index, {r('list_dot_product(p.shared, o.shared)', 'overlap')}
FROM d JOIN v_shared p ON p.target_language = d.target_language AND p.triplet_row_index = d.permuted
JOIN v_shared o ON o.target_language = d.target_language AND o.triplet_row_index = d.triplet_row_index"""
ORACLE["feature_upsert"] = f"""
SELECT model, block, state, target_language, condition, count(*) AS n_rows,
  {r("sum(CASE condition WHEN 'SPECIFIC' THEN 2e0 ELSE 1e0 END * sqrt(list_dot_product(vec, vec)))", 'norm_sum')} FROM v_features GROUP BY 1, 2, 3, 4, 5"""

# ------------------------------------------------------------------ texts. RE2 has no Unicode \\s, so the class is spelled out.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LATIN = rf"\p{{L}}+(?:[''’-]\p{{L}}+)*|\p{{N}}+|[^\p{{L}}\p{{N}}{SPACE}]|[{SPACE}]+"
HAN = rf"\p{{Han}}|[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{SPACE}]|[{SPACE}]+"


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def segmented(source: str, keys: str, language: str = "language") -> str:
    """Word table of ``source`` (keys, language, text)."""
    over = f"PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING"
    return f"""
SELECT {keys}, {language} AS lang_, word_index, word_text, word_char_start, word_char_end, CASE WHEN punct THEN 'PUNCT' END AS upos,
  CASE WHEN punct THEN 'PUNCT'
    WHEN word_index IN (min(word_index) FILTER (NOT punct) OVER (PARTITION BY {keys}), max(word_index) FILTER (NOT punct) OVER (PARTITION BY {keys})) THEN 'EDGE'
    WHEN {language} = 'EN' AND lower(word_text) IN {quoted(EN_FUNCTION_WORDS)} THEN 'FUNCTION'
    WHEN {language} = 'FR' AND lower(word_text) IN {quoted(FR_FUNCTION_WORDS)} THEN 'FUNCTION' ELSE 'CONTENT' END AS token_class
FROM (SELECT *, regexp_full_match(word_text, '\\p{{P}}+') AS punct FROM (
  SELECT *, CAST(sum(is_word) OVER ({over}) - 1 AS INTEGER) AS word_index, CAST(sum(length(word_text)) OVER ({over}) AS INTEGER) AS word_char_end,
    CAST(sum(length(word_text)) OVER ({over}) - length(word_text) AS INTEGER) AS word_char_start
  FROM (SELECT *, CAST(NOT regexp_matches(word_text, '^[{SPACE}]') AS INTEGER) AS is_word FROM (
    SELECT {keys}, {language}, unnest(m) AS word_text, unnest(range(len(m))) AS pos FROM (
      SELECT *, CASE WHEN {language} = 'ZH' THEN regexp_extract_all(text, '{HAN}') ELSE regexp_extract_all(text, '{LATIN}') END AS m FROM {source}))))
  WHERE is_word = 1)"""


VIEWS["v_lines"] = """
SELECT doc_id, upper(lang) AS language, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS text
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)"""
VIEWS["v_line_words"] = segmented("v_lines", "doc_id, line_no, language")
ORACLE["segmented_words"] = """
SELECT doc_id, line_no, language, word_index, word_text, word_char_start, word_char_end, upos, token_class FROM v_line_words"""
VIEWS["v_turns"] = "SELECT conv_id, turn, 'FR' AS language, text FROM conversations"
VIEWS["v_turn_words"] = segmented("v_turns", "conv_id, turn")
PIECES = "list_transform(range(CAST(ceil(length(text) / 4e0) AS BIGINT)), lambda i: {{'s': i * 4, 'e': least(i * 4 + 4, length(text))}})".replace("{{", "{").replace("}}", "}")
VIEWS["v_turn_pieces"] = f"""
SELECT conv_id, turn, text, 0 AS i, 0 AS s, 0 AS e FROM conversations UNION ALL
SELECT conv_id, turn, text, i, p.s, p.e FROM (SELECT conv_id, turn, text, unnest({PIECES}) AS p, unnest(range(1, CAST(ceil(length(text) / 4e0) AS BIGINT) + 1)) AS i FROM conversations)"""
ORACLE["words_to_subwords"] = """
SELECT w.conv_id, w.turn, word_index, word_text, word_char_start, word_char_end, upos, token_class, CAST(min(i) AS INTEGER) AS first_subword,
  CAST(max(i) AS INTEGER) AS last_subword, CAST(coalesce(max(i) - min(i) + 1, 0) AS INTEGER) AS n_subwords_deleted
FROM v_turn_words w LEFT JOIN v_turn_pieces p ON p.conv_id = w.conv_id AND p.turn = w.turn AND e > s AND s < word_char_end AND e > word_char_start
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
VIEWS["v_story0"] = """
SELECT n // 3 AS triplet_id, max(text) FILTER (n % 3 = 0) AS en_text, max(text) FILTER (n % 3 = 1) AS fr_text,
  max(text) FILTER (n % 3 = 2) AS zh_text FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations)
GROUP BY 1 HAVING count(DISTINCT n % 3) FILTER (text IS NOT NULL) = 3"""
VIEWS["v_story"] = """
SELECT *, CAST(triplet_row_index % 6 + 1 AS INTEGER) AS canonical_run, CAST((triplet_row_index // 6) * 5 % 930 AS DOUBLE) AS place
FROM (SELECT *, row_number() OVER (ORDER BY triplet_id) - 1 AS triplet_row_index FROM v_story0)"""
VIEWS["v_story_rows"] = """
SELECT triplet_id, triplet_row_index, canonical_run, 'EN' AS language, en_text AS text, place AS onset_sec, place + length(en_text) / 40e0 AS offset_sec FROM v_story
UNION ALL SELECT triplet_id, triplet_row_index, canonical_run, 'FR', fr_text, place + 0.4e0, place + 0.4e0 + length(fr_text) / 40e0 FROM v_story
UNION ALL SELECT triplet_id, triplet_row_index, canonical_run, 'ZH', zh_text, place + 0.8e0, place + 0.8e0 + length(zh_text) / 40e0 FROM v_story"""
ORACLE["story_triplet_index"] = f"""
SELECT triplet_id, triplet_row_index, canonical_run, en_text, fr_text, zh_text, {r('place', 'en_onset_sec')}, {r('place + length(en_text) / 40e0', 'en_offset_sec')},
  {r('place + 0.4e0', 'fr_onset_sec')}, {r('place + 0.4e0 + length(fr_text) / 40e0', 'fr_offset_sec')},
  {r('place + 0.8e0', 'zh_onset_sec')}, {r('place + 0.8e0 + length(zh_text) / 40e0', 'zh_offset_sec')} FROM v_story"""
VIEWS["v_subset"] = """
SELECT target_language, CAST(canonical_run AS BIGINT) AS canonical_run, CAST(triplet_id AS VARCHAR) AS triplet_id, triplet_row_index, 'strict' AS token_subset_name,
  CAST(rank AS INTEGER) AS token_subset_rank
FROM (SELECT *, row_number() OVER (PARTITION BY canonical_run ORDER BY triplet_row_index) AS rank FROM v_story), v_targets3 WHERE rank <= 15"""
ORACLE["token_subset"] = "FROM v_subset"
ORACLE["subset_triplets"] = f"""
SELECT u.target_language, u.canonical_run, u.triplet_id, u.token_subset_rank, s.en_text, {r('s.place', 'en_onset_sec')}
FROM v_subset u LEFT JOIN v_story s ON CAST(s.triplet_id AS VARCHAR) = u.triplet_id WHERE u.target_language IN ('EN', 'FR')"""
ORACLE["underfilled_runs"] = "SELECT canonical_run, count(*) AS n_triplets FROM v_story GROUP BY 1 HAVING count(*) < 30"
VIEWS["v_story_words"] = segmented("v_story_rows", "triplet_row_index, language")
VIEWS["v_story_word_texts"] = """
SELECT w.*, s.text, s.canonical_run FROM v_story_words w JOIN v_story_rows s USING (triplet_row_index, language)"""


def cut_span(text: str, start: str, end: str, language: str = "language") -> str:
    rest = f"substr({text}, 1, {start}) || substr({text}, {end} + 1)"
    return f"CASE WHEN {language} IN ('EN', 'FR') THEN trim(regexp_replace({rest}, '[{SPACE}]+', ' ', 'g')) ELSE {rest} END"


ORACLE["single_word_deletions"] = f"""
SELECT triplet_row_index, language AS sentence_language, word_index, {cut_span('text', 'word_char_start', 'word_char_end')} AS mutated_text FROM v_story_word_texts"""
ORACLE["multi_word_deletions"] = f"""
WITH RECURSIVE spans AS (SELECT triplet_row_index, language, text, list({{'s': word_char_start, 'e': word_char_end}} ORDER BY word_char_start DESC) AS sp
  FROM v_story_word_texts WHERE token_class IN ('FUNCTION', 'EDGE') GROUP BY 1, 2, 3),
step AS (SELECT triplet_row_index, language, sp, text, 0 AS i FROM spans
  UNION ALL SELECT triplet_row_index, language, sp, {cut_span('text', 'sp[i + 1].s', 'sp[i + 1].e')}, i + 1 FROM step WHERE i < len(sp))
SELECT triplet_row_index, language AS sentence_language, text AS mutated_text FROM step WHERE i = len(sp)"""
ORACLE["slugs"] = """
SELECT page_id, CASE WHEN s = '' THEN 'na' ELSE s END AS slug
FROM (SELECT page_id, lower(trim(regexp_replace(trim(url), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS s FROM pages)"""
DIGIT = "(instr('0123456789abcdef', substr({h}, {d}, 1)) - 8.5e0) / 7.5e0"
ORACLE["pooled_tokens"] = f"""
WITH tok AS (SELECT conv_id, turn, sha256(substr(text, s + 1, e - s)) AS h FROM v_turn_pieces WHERE i > 0),
means AS (SELECT conv_id, turn, d, count(*) AS n, avg({DIGIT.format(h='h', d='d + 1')}) AS m FROM tok, (SELECT unnest(range(8)) AS d) GROUP BY 1, 2, 3)
SELECT conv_id, turn, n AS n_tokens_pooled, CAST(d AS INTEGER) AS dim, {r('m / greatest(sqrt(sum(m * m) OVER (PARTITION BY conv_id, turn)), 1e-8)', 'value')} FROM means"""
ORACLE["token_metadata"] = """
SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS sequence_length, CAST(count(*) - 1 AS INTEGER) AS n_tokens_pooled, CASE WHEN count(*) > 1 THEN 1 ELSE -1 END AS first_pooled_token_index,
  CASE WHEN count(*) > 1 THEN CAST(count(*) - 1 AS INTEGER) ELSE -1 END AS last_pooled_token_index, true AS has_offset_mapping, any_value(text) AS joined,
  CAST(('0x' || substr(md5(arg_max(substr(text, s + 1, e - s), i)), 1, 6))::BIGINT AS INTEGER) AS last_token_id, CAST(max(e) AS INTEGER) AS last_end
FROM v_turn_pieces GROUP BY 1, 2"""
ORACLE["mapping_failures"] = """
WITH s AS (SELECT triplet_row_index, language AS sentence_language, CASE WHEN contains(text, '?') THEN 'missing_token_metadata'
    WHEN contains(text, chr(10)) THEN 'offset_mapping_failed' END AS reason FROM v_story_rows)
SELECT triplet_row_index, sentence_language, -1 AS word_index, '' AS word_text, -1 AS word_char_start, -1 AS word_char_end, reason AS failure_reason, 'FAILED' AS mapping_status
FROM s WHERE reason IS NOT NULL
UNION ALL SELECT w.triplet_row_index, language, word_index, word_text, word_char_start, word_char_end, 'offset_mapping_failed', 'FAILED'
FROM v_story_words w JOIN s ON s.triplet_row_index = w.triplet_row_index AND s.sentence_language = w.language
WHERE s.reason IS NULL AND word_char_start // 4 = (word_char_end - 1) // 4 AND (word_char_start // 4) % 3 = 2"""


def encoded(source: str, keys: str) -> str:
    """Unit-length mean of SHA-256 digits over the blank-separated words of ``source`` (keys, text), in long form."""
    return f"""
SELECT {keys}, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY {keys})), 1e-8) AS v FROM (
  SELECT {keys}, d, coalesce(avg({DIGIT.format(h='h', d='d + 1')}), 0e0) AS m FROM (
    SELECT {keys}, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE list_transform(w, lambda x: sha256(x)) END) AS h FROM (
      SELECT {keys}, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS w FROM {source})), (SELECT unnest(range(8)) AS d) GROUP BY {keys}, d)"""


VIEWS["v_story_vectors"] = encoded("v_story_rows", "triplet_row_index, language")
ORACLE["distinct_text_encoding"] = f"SELECT language, triplet_row_index, CAST(d AS INTEGER) AS dim, {r('v', 'value')} FROM v_story_vectors"
ORACLE["filled_row_index"] = """
SELECT o_orderkey, o_custkey + 3 AS triplet_id, CAST(c_nationkey AS BIGINT) AS triplet_row_index FROM orders JOIN customer ON c_custkey = o_custkey + 3"""
ORACLE["parsed_token_metadata"] = """
SELECT p_partkey, CAST(i AS INTEGER) AS token_index, substr(p_name, CAST(i * 4 + 1 AS INTEGER), 4) AS token, i * 4 AS start, least(i * 4 + 4, length(p_name)) AS "end"
FROM (SELECT p_partkey, p_name, unnest(range((length(p_name) + 3) // 4)) AS i FROM part)"""
VIEWS["v_longer"] = "SELECT triplet_row_index, text || ' encore' AS text FROM v_story_rows WHERE language = 'FR' AND triplet_row_index % 2 = 0"
VIEWS["v_longer_vectors"] = encoded("v_longer", "triplet_row_index")
ORACLE["mutated_shared_vectors"] = f"""
SELECT f.triplet_row_index, CAST(f.d AS INTEGER) AS dim, {r('(coalesce(c.v, f.v) + z.v) / 2', 'value')}
FROM (FROM v_story_vectors WHERE language = 'FR') f JOIN (FROM v_story_vectors WHERE language = 'ZH') z ON z.triplet_row_index = f.triplet_row_index AND z.d = f.d
LEFT JOIN v_longer_vectors c ON c.triplet_row_index = f.triplet_row_index AND c.d = f.d"""
ORACLE["packed_batches"] = """
WITH RECURSIVE p AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position, greatest(1, n_chars) AS cost FROM documents),
step AS (SELECT lang, position, cost AS fill, 0::BIGINT AS batch_index FROM p WHERE position = 0
  UNION ALL SELECT p.lang, p.position, CASE WHEN fill + cost > 8192 THEN cost ELSE fill + cost END, CASE WHEN fill + cost > 8192 THEN batch_index + 1 ELSE batch_index END
  FROM step JOIN p ON p.lang = step.lang AND p.position = step.position + 1)
SELECT lang, position, batch_index FROM step"""

# ------------------------------------------------------------------ timeline and design
VIEWS["v_kernel"] = f"SELECT lag, h, sum(h) OVER (ORDER BY lag) AS hsum FROM (SELECT unnest(range(320)) AS lag, unnest({KERNEL}) AS h)"
VIEWS["v_events"] = """
SELECT event_id, user_id, event_type, value, CAST(us // 432000000000 + 1 AS INTEGER) AS canonical_run, (us % 432000000000) / 450000000e0 AS t,
  CASE event_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'ZH' END AS language
FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events)"""
VIEWS["v_grid"] = """
SELECT language, canonical_run, CAST(scan AS INTEGER) AS scan FROM (SELECT DISTINCT canonical_run FROM v_events), (SELECT unnest(['EN', 'FR', 'ZH']) AS language), (SELECT unnest(range(480)) AS scan)"""
VIEWS["v_timing"] = """
SELECT language, canonical_run, event_id AS triplet_row_index, t AS onset_sec, t + value / 10e0 AS offset_sec FROM v_events WHERE event_type = 'view'"""


def basis(timing: str) -> str:
    return f"""
SELECT t.language, t.canonical_run, CAST(s.scan AS INTEGER) AS scan, t.triplet_row_index,
  coalesce(a.hsum, 1e0) - coalesce(z.hsum, CASE WHEN s.scan * 20 < off_ THEN 0e0 ELSE 1e0 END) AS weight
FROM (SELECT *, least(greatest(on_ + 1, ceil(offset_sec * 10e0)), 9600) AS off_ FROM (SELECT *, greatest(0, floor(onset_sec * 10e0)) AS on_ FROM {timing})) t
JOIN (SELECT unnest(range(480)) AS scan) s ON s.scan * 20 >= on_ AND s.scan * 20 < off_ + 319
LEFT JOIN v_kernel a ON a.lag = s.scan * 20 - on_ LEFT JOIN v_kernel z ON z.lag = s.scan * 20 - off_ WHERE on_ < off_"""


VIEWS["v_basis"] = basis("v_timing")
ORACLE["sentence_basis"] = f"SELECT language, canonical_run, scan, triplet_row_index, {rs('weight')} FROM v_basis"


def impulse(event: str) -> str:
    return f"""SELECT language, canonical_run, least(greatest(round_even(t * 10e0, 0), 0), 9599) AS fi, CAST(count(*) AS DOUBLE) AS value
FROM v_events WHERE event_type = '{event}' GROUP BY 1, 2, 3"""


VIEWS["v_clicks"] = impulse("click")
VIEWS["v_views"] = impulse("view")
VIEWS["v_boxes"] = """
SELECT DISTINCT language, canonical_run, unnest(range(CAST(a AS BIGINT), CAST(greatest(a + 1, least(ceil((t + value / 10e0) * 10e0), 9600)) AS BIGINT))) AS fi, 1e0 AS value
FROM (SELECT *, least(greatest(floor(t * 10e0), 0), 9599) AS a FROM v_events WHERE event_type = 'purchase')"""


def line(event: str) -> str:
    return f"""
SELECT language, canonical_run, fi, coalesce(value + (fi / 10e0 - t) * ((nv - value) / (nt - t)), value) AS value FROM (
  SELECT *, unnest(range(CAST(greatest(0, ceil(t * 10e0)) AS BIGINT), CAST(least(coalesce(ceil(nt * 10e0) - 1, floor(t * 10e0)), 9599) AS BIGINT) + 1)) AS fi
  FROM (SELECT language, canonical_run, t, value, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM v_events WHERE event_type = '{event}'
    WINDOW w AS (PARTITION BY language, canonical_run ORDER BY t, value)))"""


VIEWS["v_line_error"] = line("error")
VIEWS["v_line_signup"] = line("signup")


def convolved(series: str, extra: str = "") -> str:
    return f"""SELECT language, canonical_run, {extra} CAST(scan AS INTEGER) AS scan, sum(value * h) AS value
FROM {series} JOIN v_kernel k ON TRUE JOIN (SELECT unnest(range(480)) AS scan) s ON s.scan * 20 = fi + lag GROUP BY ALL"""


ORACLE["impulse_regressor"] = f"SELECT language, canonical_run, scan, {rs('value')} FROM ({convolved('v_clicks')})"
ORACLE["boxcar_regressor"] = f"SELECT language, canonical_run, scan, {rs('value')} FROM ({convolved('v_boxes')})"
ORACLE["continuous_regressor"] = f"SELECT language, canonical_run, scan, {rs('value')} FROM ({convolved('v_line_error')})"
VIEWS["v_drift"] = """
SELECT language, canonical_run, scan, 'intercept' AS name, 1e0 AS value FROM v_grid
UNION ALL SELECT language, canonical_run, scan, 'linear_trend', -1e0 + 2e0 * scan / 479e0 FROM v_grid
UNION ALL SELECT language, canonical_run, scan, printf('highpass_%02d', k - 1), cos(pi() * (scan + 0.5e0) * k / 480e0)
FROM v_grid, (SELECT unnest(range(1, 16)) AS k)"""
ORACLE["drift_terms"] = f"SELECT language, canonical_run, scan, name, {rs('value')} FROM v_drift"
VIEWS["v_pictures"] = """
SELECT language, 1 AS canonical_run, a, z FROM (SELECT unnest(['EN', 'ZH']) AS language), (SELECT unnest([10e0, 35e0, 60e0]) AS a, unnest([25e0, 55e0, 75e0]) AS z)"""
VIEWS["v_series"] = """
SELECT 'rms' AS name, language, canonical_run, fi, value FROM v_line_error UNION ALL SELECT 'f0', language, canonical_run, fi, value FROM v_line_signup
UNION ALL SELECT 'word_rate', language, canonical_run, fi, value FROM v_clicks UNION ALL SELECT 'sentence_onset', language, canonical_run, fi, value FROM v_views
UNION ALL SELECT 'picture_event', language, canonical_run, round_even(a * 10e0, 0), 1e0 FROM v_pictures
UNION ALL SELECT 'picture_block', language, canonical_run, unnest(range(CAST(floor(a * 10e0) AS BIGINT), CAST(ceil(z * 10e0) AS BIGINT))), 1e0 FROM v_pictures"""
VIEWS["v_acoustic"] = convolved("v_series", "name,")
NAMES = [f"highpass_{k:02d}" for k in range(15)] + ["intercept", "linear_trend", "f0", "picture_block", "picture_event", "rms", "sentence_onset", "word_rate"]
VIEWS["v_names"] = f"SELECT unnest({NAMES}) AS name, unnest(range({len(NAMES)})) AS position"
VIEWS["v_nuisance"] = """
SELECT g.language, g.canonical_run, g.scan, n.position, coalesce(t.value, 0e0) AS value FROM v_grid g CROSS JOIN v_names n
LEFT JOIN (FROM v_drift UNION ALL SELECT language, canonical_run, scan, name, value FROM v_acoustic) t
ON t.language = g.language AND t.canonical_run = g.canonical_run AND t.scan = g.scan AND t.name = n.name"""
ORACLE["nuisance_rows"] = f"SELECT language, canonical_run, scan, CAST(position AS INTEGER) AS position, {rs('value')} FROM v_nuisance"
ORACLE["response_windows"] = """
SELECT language, canonical_run, triplet_row_index, CAST(scan AS INTEGER) AS scan FROM v_timing, (SELECT unnest(range(480)) AS scan)
WHERE scan * 2e0 >= onset_sec + 2e0 AND scan * 2e0 < offset_sec + 12e0"""
VIEWS["v_bold"] = """
SELECT CASE u % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'ZH' END AS language, 'U' || u AS subject_id, canonical_run, CAST(floor(t / 2e0) AS INTEGER) AS scan,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS roi_index, sum(value) AS value
FROM (SELECT *, user_id % 24 AS u FROM v_events) GROUP BY 1, 2, 3, 4, 5"""
VIEWS["v_rois5"] = "SELECT unnest([1, 2, 3, 4, 5]) AS roi_index, unnest(['SEMANTIC', 'SEMANTIC', 'AUDITORY', 'AUDITORY', 'CONTROL']) AS roi_family"
ORACLE["family_series"] = f"""
SELECT language, subject_id, roi_family, canonical_run, scan, {r('avg(value)', 'value')} FROM v_bold JOIN v_rois5 USING (roi_index) GROUP BY 1, 2, 3, 4, 5"""
VIEWS["v_target_index"] = """
SELECT CASE u % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'ZH' END AS language, 'U' || u AS subject_id, roi_index, (u // 3) * 5 + roi_index - 1 AS target_index
FROM (SELECT unnest(range(24)) AS u), v_rois5"""
ORACLE["stacked_targets"] = f"""
SELECT g.language, g.canonical_run, g.scan, CAST(target_index // 16 AS INTEGER) AS chunk, CAST(target_index % 16 AS INTEGER) AS position, {r('coalesce(b.value, 0e0)', 'value')}
FROM v_grid g JOIN v_target_index i ON i.language = g.language
LEFT JOIN v_bold b ON b.language = g.language AND b.subject_id = i.subject_id AND b.roi_index = i.roi_index AND b.canonical_run = g.canonical_run AND b.scan = g.scan"""
VIEWS["v_sentence_features"] = """
SELECT t.language, f.block, f.condition, t.triplet_row_index, f.vec
FROM v_timing t JOIN (SELECT target_language AS language, block, count(*) AS n FROM v_specific GROUP BY 1, 2) c ON c.language = t.language
JOIN v_features f ON f.target_language = t.language AND f.block = c.block AND f.triplet_row_index // 4 = t.triplet_row_index % c.n AND f.condition <> 'RAW'"""
VIEWS["v_design"] = """
SELECT language, block, condition, canonical_run, scan, dim, sum(weight * v) AS x FROM (
  SELECT b.language, f.block, f.condition, b.canonical_run, b.scan, b.weight, unnest(f.vec) AS v, unnest(range(64)) AS dim
  FROM v_basis b JOIN v_sentence_features f ON f.language = b.language AND f.triplet_row_index = b.triplet_row_index) GROUP BY 1, 2, 3, 4, 5, 6"""
ORACLE["design_matrix"] = f"""
SELECT 'm0' AS model, language, block, 'OUTPUT' AS state, condition, canonical_run, scan, {r('sum(x)', 'x_sum')}, {r('sum(x * x)', 'x_sq')} FROM v_design GROUP BY 2, 3, 5, 6, 7"""
