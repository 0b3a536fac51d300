"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``window`` consecutive words (the whole item if it has fewer), a window a set of word
shingles. Full containment of a window needs every one of its shingles, so its prefix is one shingle: the rarest of the corpus.
Only prefix shingles are joined with the documents' positions; length and position bounds drop candidates whose window would
stick out of the text; the rest is compared word by word over a stretch of the window's size.

The first pass over the texts keeps the positions of shingles that occur in any item, and one end mark with the number of
words for each document; rarity, prefixes and candidates come from that small table. The second pass reads the texts of
candidate documents only. Shingles are compared by hash of their words, lower-cased A-Z like the words that are compared at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxelweave.llm.common import ascii_lower, sized, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 5
END_MARK = 0


def split_words(text: Column) -> Column:
    """Words are runs of letters, digits and anything beyond ASCII; null has none."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def _hashes(words: str, size: int) -> Column:
    """Hash of each run of ``size`` words, by position; END_MARK is kept free."""
    def at(i: Column) -> Column:
        h = F.xxhash64(*[F.get(F.col(words), i + j) for j in range(size)])
        return F.when(h == END_MARK, F.lit(1).cast("long")).otherwise(h)

    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at)).otherwise(F.array().cast("array<long>"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: (window_text, size, items array, shingles array). Items without words have none."""
    words = benchmark.select(F.col("item_id"), split_words(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 0)
    size = F.least(F.lit(window), F.size("words"))
    each = words.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("words"))
    per = each.groupBy("words", "size").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hashes = _hashes("words", SHINGLE)
    for k in range(SHINGLE - 1, 0, -1):
        hashes = F.when(F.col("size") == k, _hashes("words", k)).otherwise(hashes)
    return per.select(F.array_join("words", " ").alias("window_text"), "size", "items", hashes.alias("shingles"))


def shingle_positions(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, pos, h): positions of the windows' shingles, and one END_MARK row for each document."""
    keys = stored(windows.select(F.explode("shingles").alias("h")).distinct(), "shingles")
    short = sorted(r[0] for r in windows.where(F.col("size") < SHINGLE).select("size").distinct().collect())  # SHINGLE - 1 values at most
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), split_words(ascii_lower(F.col("text"))).alias("words"))
    marked = keys.union(keys.sparkSession.createDataFrame([(END_MARK,)], "h long"))
    if keys.count() > 0:
        marked = sized(stored(marked, "marked_shingles"))
    found = None
    for k in [SHINGLE, *short]:
        hashes = _hashes("words", k)
        if found is None:
            hashes = F.concat(hashes, F.array(F.lit(END_MARK).cast("long")))
        one = texts.select("doc_id", "text_key", F.size("words").alias("n_words"), F.posexplode(hashes).alias("pos", "h")).join(marked, "h").select("doc_id", "text_key", "n_words", "pos", "h")
        found = one if found is None else found.union(one)
    return stored(found, "positions")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of ``documents``.

    A word is hit if it lies in an occurrence of a window of any item. contaminated: some word is hit and ``share`` times the
    hit words reach the words of the document. Only doc_id, text and item_id, text are read, so further columns may have any
    name. Null or empty texts have no words and are clean; so is every document if the benchmark is empty. Repeated rows and
    ids come back as often as given, each judged by its own text; a null doc_id is kept. Items with null ids hit words but
    are not counted or listed. Repeated items count once. Texts of any length are read whole.
    """
    windows = stored(benchmark_windows(benchmark, window), "windows")
    positions = shingle_positions(documents, windows)
    hits, ends = positions.where(F.col("h") != END_MARK), positions.where(F.col("h") == END_MARK)

    rarity = hits.groupBy("h").agg(F.count("*").alias("n"))
    numbered = windows.select("window_text", "size", "items", F.posexplode("shingles").alias("offset", "h"))
    prefix = stored(
        numbered.join(rarity, "h").groupBy("window_text", "size", "items")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "h", "offset")).alias("rarest"))
        .where(F.col("known") == F.when(F.col("size") < SHINGLE, 1).otherwise(F.col("size") - SHINGLE + 1))  # all shingles must occur somewhere
        .select("window_text", "size", "items", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset")),
        "prefixes",
    )
    start = F.col("pos") - F.col("offset")
    candidates = stored(
        hits.join(sized(prefix), "h").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .select("doc_id", "text_key", start.alias("start"), "size", "window_text", "items").distinct(),
        "candidates",
    )
    suspects = stored(candidates.select("doc_id", "text_key").distinct(), "suspects")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    texts = keyed.join(sized(suspects), same(keyed, suspects), "left_semi").dropDuplicates(["doc_id", "text_key"])
    listed = candidates.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "size", "window_text", "items"))).alias("found"))
    true = F.filter("found", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ") == c["window_text"])
    verified = (
        texts.join(listed, same(texts, listed)).select(texts["doc_id"], texts["text_key"], split_words(ascii_lower(F.col("text"))).alias("words"), "found")
        .select("doc_id", "text_key", true.alias("found"))
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "found", none,
        lambda a, c: F.struct(
            F.greatest(a["end"], c["start"] + c["size"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), c["start"] + c["size"] - F.greatest(a["end"], c["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    judged = stored(
        verified.select("doc_id", "text_key", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"])))).alias("items")),
        "judged",
    )
    joined = ends.join(sized(judged), same(ends, judged), "left").select(ends["doc_id"], F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return joined.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``documents`` without the contaminated ones; columns and texts stay. Ids are taken as unique here: where an id stands
    for several texts and one is contaminated, all of them go. Rows without an id stay."""
    bad = stored(contamination(documents, benchmark, window, share).where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return documents.join(sized(bad), "doc_id", "left_anti").select(*documents.columns)


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS l FROM iw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT l FROM win),
pos AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= l),
occ AS (SELECT r, i, p.l, item_id FROM (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM pos) p JOIN win ON win.l = p.l AND win.t = p.t),
cov AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT r, i, l FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
