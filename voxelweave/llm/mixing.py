"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words: its weight's share of ``share`` times all words, at most ``epochs`` times what the source
has, the excess going to the others by weight. A source gives complete epochs first; the rest of its target is a weighted sample
without replacement: a document draws the key -ln(u) / weight, documents are taken in the order of keys until a prefix sum of
words reaches the rest. u is a hash of seed and id, so reruns and retries draw alike.

Prefix sums need no source in one task: rows are range-partitioned by (source, key), summed within each partition, and the
partitions' totals (one row per source and partition) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import sized, stored

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def variety(words_column: Column) -> Column:
    """A quality weight between 0.05 and 1: distinct words over words."""
    n = F.size(words_column)
    return F.when(n > 0, F.greatest(F.lit(0.05), F.size(F.array_distinct(words_column)) / n)).otherwise(0.05)


def targets(by_source: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size). Windows run over sources only."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    base = by_source.withColumn("w", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("want", F.lit(float(share)) * F.sum("source_size").over(everything))
    # By rising cap / weight, the capped sources are the first ones: each whose even share of what is left reaches its cap.
    filling = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("want") - (F.sum("cap").over(filling) - F.col("cap"))) / (F.sum("w").over(everything) - (F.sum("w").over(filling) - F.col("w")))
    capped = base.withColumn("capped", level * F.col("w") >= F.col("cap"))
    free = lambda c: F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col(c))).over(everything)
    rest = F.col("want") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(rest / free("w") * F.col("w")).alias("target"))


def mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 42, quality=variety) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of ``documents``.

    size: words of the text, 0 for null. ``weights`` repeat over the sources in code point order, the null source last.
    taken: size times how often the mix takes the document; at most the next whole number from ``epochs`` times. The last
    document of a sample is taken if at least half of it fits, so a source misses its target by half a document at most.
    Only doc_id, text and source are read, so further columns may have any name. Repeated rows are separate documents with
    one key; ties fall by size and text. A null id draws as one id of its own. A source without words has target 0. An
    empty table gives no rows. ``quality``: weight of an array of words.
    """
    base = documents.select("doc_id", "source", words(F.col("text")).alias("words"), F.xxhash64("text").alias("tie"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = stored(base.select("doc_id", "source", "tie", F.size("words").cast("long").alias("size"), (-F.log(u) / quality(F.col("words"))).alias("key")), "keyed")
    plan = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "targets")

    order = ["source", "key", "doc_id", "size", "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("source", "part").agg(F.sum("size").alias("total"))
    offsets = stored(totals.select("source", "part", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("offset")), "offsets")
    inside = Window.partitionBy("source", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("upto", F.sum("size").over(inside))

    def on(a: DataFrame, b: DataFrame, *also: str) -> Column:
        return a["source"].eqNullSafe(b["source"]) if not also else a["source"].eqNullSafe(b["source"]) & (a["part"] == b["part"])

    placed = summed.join(sized(offsets), on(summed, offsets, "part")).select(summed["doc_id"], summed["source"], "size", (F.col("upto") + F.col("offset")).alias("upto"))
    joined = placed.join(sized(plan), on(placed, plan)).select("doc_id", placed["source"], "size", "upto", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    extra = F.when(F.col("upto") - F.col("size") / 2 <= rest, 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (whole + F.when(rest > 0, extra).otherwise(0))).cast("long").alias("taken"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """``documents`` as often as the mix takes them (empty texts once); columns and texts stay. Ids are taken as unique: of an
    id with several texts all follow the smallest count, and rows without an id stay once."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    counts = stored(mix(documents, **how).where("doc_id is not null").groupBy("doc_id").agg(F.min(times).alias("mix_times_")), "times")
    other = counts.where("mix_times_ <> 1")
    with_times = documents.join(sized(stored(other, "not_once")), "doc_id", "left").withColumn("mix_times_", F.coalesce("mix_times_", F.lit(1)))
    repeated = with_times.where("mix_times_ > 0").withColumn("mix_copy_", F.explode(F.sequence(F.lit(1), F.col("mix_times_"))))
    return repeated.select(*documents.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
  -ln((CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
  / CASE WHEN len(w) > 0 THEN greatest(CAST(0.05 AS DOUBLE), CAST(len(list_distinct(w)) AS DOUBLE) / CAST(len(w) AS DOUBLE)) ELSE CAST(0.05 AS DOUBLE) END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
b AS (SELECT source, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS want FROM s),
f AS (SELECT *, sum(cap) OVER o - cap AS cap_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_left FROM b
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, (want - cap_before) / w_left * w >= cap AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (want - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER () * w END AS target FROM c),
p AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
j AS (SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.upto, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-9) ELSE 0 END AS whole
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j
"""
