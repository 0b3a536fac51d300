"""Line dedup by winnowing over line hashes.

The lines of a text that have words form a sequence. From each line starts a window: the shortest stretch of lines with
``min_words`` words or more. The smallest line hash of a window is its fingerprint, so any two texts that share a run of lines
with ``min_words`` words share a fingerprint: the run holds a whole window, and that selects the same line in both.

Only fingerprints at two or more positions are followed. Around each of them the windows that selected it are joined by their
content; a window is repeated if an equal one begins earlier, in the order of (doc_id, line). Matches are then extended both
ways: overlapping repeated windows make up the run, and a window that ends with a line, counted backwards, carries the run on
to its last line. What is deleted is every line inside a run of ``min_words`` words or more that occurs earlier.

Equal windows are told apart from the first of their group only, so a group of n copies costs n rows, not n^2 pairs.
Windows are frames over word offsets within one document; documents never share a task by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import sized, stored
from voxelweave.llm.mixing import SPACES

KEY = ("doc_id", "text_key")
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def text_lines(text: Column) -> Column:
    """Lines at every line feed, without white space at their ends; null has none."""
    return F.coalesce(F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, TRIM, "")), F.array().cast("array<string>"))


def line_positions(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, h, words, upto): lines with words, and the words before each. Repeated rows count once."""
    lines = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(text_lines(F.col("text"))).alias("line", "s"))
    sized_lines = lines.where("s <> ''").select(*KEY, "line", F.xxhash64("s").alias("h"), F.size(F.split("s", SPACES)).alias("words"))
    dealt = sized_lines.repartition(*KEY).dropDuplicates([*KEY, "line"])
    order = Window.partitionBy(*KEY).orderBy("line")
    return dealt.withColumn("upto", F.sum("words").over(order) - F.col("words"))


def repeated_lines(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, text_key, removed array of line numbers, sorted) of texts that repeat an earlier run."""
    placed = line_positions(documents)
    within = Window.partitionBy(*KEY)
    ahead = within.orderBy("upto").rangeBetween(0, min_words - 1)
    behind = within.orderBy("end").rangeBetween(1 - min_words, 0)
    content = lambda w: F.xxhash64(F.collect_list("h").over(w))
    framed = placed.withColumn("end", F.col("upto") + F.col("words")).withColumn("total", F.sum("words").over(within))
    spans = stored(
        framed.select(
            *KEY, "line",
            F.when(F.col("total") - F.col("upto") >= min_words, content(ahead)).alias("forward"), F.min(F.struct("h", "line")).over(ahead).alias("forward_print"), F.max("line").over(ahead).alias("last"),
            F.when(F.col("end") >= min_words, content(behind)).alias("backward"), F.min(F.struct("h", "line")).over(behind).alias("backward_print"), F.min("line").over(behind).alias("first"),
        ),
        "spans",
    )
    windows = (
        spans.where("forward is not null").select(*KEY, F.col("line").alias("first"), "last", F.col("forward").alias("content"), F.col("forward_print").alias("print"))
        .union(spans.where("backward is not null").select(*KEY, "first", F.col("line").alias("last"), "backward", "backward_print"))
    )
    windows = windows.select(*KEY, "first", "last", "content", F.col("print.h").alias("print"), F.col("print.line").alias("at"))
    # A fingerprint at one position only has no partner; windows with the same content select the same fingerprint.
    place = F.struct(*KEY, "at")
    prints = stored(windows.groupBy("print").agg((F.min(place) != F.max(place)).alias("more")).where("more").select("print"), "prints")
    followed = windows.join(sized(prints), "print")
    earliest = followed.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY, "first")).alias("origin"), F.count("*").alias("n")).where("n > 1").select("content", "origin")
    matched = followed.join(sized(stored(earliest, "earliest")), "content").where(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY, "first") > F.col("origin"))
    # A window counted forwards is deleted whole; one counted backwards lies in the run as well, whose last line it carries.
    spread = matched.select(*KEY, F.explode(F.sequence("first", "last")).alias("line"))
    return spread.groupBy(*KEY).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicate_lines(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """Rows (doc_id, text, n_lines, n_removed, removed), one for each row of ``documents``: ``text`` without the lines of
    later repeated runs, ``removed`` the numbers (from 0) of the lines that went.

    A run is a stretch of lines with words, compared without white space at line ends; lines without words neither break nor
    make a run, and go only if they lie inside one. The first occurrence stays: the smallest doc_id, nulls last, then
    the smallest hash of the text, then the earlier line, also within one text. Only doc_id and text are read, so further
    columns may have any name. Null text stays null with no lines; empty texts have one line without words. Repeated rows
    are one text and all keep it. An empty table gives no rows.
    """
    found = stored(repeated_lines(documents, min_words), "repeated_lines")
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    side = found if total > 2_000_000 else sized(found)  # ids and at most that many line numbers
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    joined = keyed.join(side, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["text_key"] == found["text_key"]), "left").select(keyed["doc_id"], "text", F.coalesce("lines", F.array().cast("array<int>")).alias("removed"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")  # by hash: linear in the lines
    kept = F.array_join(F.transform(numbers, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))).select(
        "doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS s0 FROM d),
tr AS (SELECT doc_id, line, regexp_replace(s0, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM raw),
ln AS (SELECT doc_id, line, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w FROM tr WHERE s <> ''),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, sum(w) OVER (PARTITION BY doc_id) AS total FROM ln),
q AS (SELECT *, e - w AS b FROM p),
f AS (SELECT doc_id, line AS first_line, max(line) OVER a AS last_line, string_agg(s, chr(10)) OVER a AS content, total - b AS left_words FROM q WINDOW a AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
k AS (SELECT doc_id, min(line) OVER a AS first_line, line AS last_line, string_agg(s, chr(10)) OVER a AS content, e AS left_words FROM q WINDOW a AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
win AS (SELECT * FROM f WHERE left_words >= 50 UNION ALL SELECT * FROM k WHERE left_words >= 50),
o AS (SELECT *, min(struct_pack(d := doc_id, l := first_line)) OVER (PARTITION BY content) AS origin FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_line, last_line + 1)) AS line FROM o WHERE struct_pack(d := doc_id, l := first_line) > origin),
g AS (SELECT doc_id, list(line ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(coalesce(removed, [])) AS BIGINT) AS n_removed, array_to_string(coalesce(removed, []), ',') AS removed,
  md5(CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(removed, i)), lambda i: ls[i + 1]), chr(10)) END) AS text_md5
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
