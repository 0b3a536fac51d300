"""Small statistical expressions: Fisher z, stable hashing, index assignment by bounded id ranges (skewed groups: ``ranks``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

R_LIMIT = 0.999999  # Fixed value: correlations are clipped to +- this before atanh.


def fisher_z(r: Column) -> Column:
    # greatest and least skip NULL, so a missing correlation has to be kept missing.
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.lit(-R_LIMIT), F.least(F.lit(R_LIMIT), r))))


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from sums, 0 when either side has no spread, clipped."""
    spread = (sxx - sx * sx / n) * (syy - sy * sy / n)
    r = F.when(spread > 0, (sxy - sx * sy / n) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(-R_LIMIT), F.least(F.lit(R_LIMIT), r))


def pearson(y: Column, p: Column) -> Column:
    """Aggregate: Pearson r of two columns, 0 when degenerate, clipped."""
    r = F.coalesce(F.nanvl(F.corr(y, p), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-R_LIMIT), F.least(F.lit(R_LIMIT), r))


def stable_offset(text: Column) -> Column:
    """sum((i + 1) * code point of character i) mod 100000, for ASCII text."""
    steps = F.sequence(F.lit(1), F.length(text))
    total = F.aggregate(
        steps, F.lit(0).cast("bigint"),
        lambda acc, i: acc + i.cast("bigint") * F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"),
    )
    return F.when(F.length(text) == 0, F.lit(0).cast("bigint")).otherwise(total % 100000)


def hash_int(*parts: Column, digits: int = 8) -> Column:
    """Non-negative integer from the first hex digits of md5(parts joined by |)."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")


def alpha_grid(low: float = -2.0, high: float = 6.0, n: int = 15) -> list[float]:
    return [10.0 ** (low + (high - low) * i / (n - 1)) for i in range(n)]


def dense_index(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], out: str = "row_index"
) -> DataFrame:
    """0-based position by (bucket, order) inside each group without putting a group into one task.

    Rows are numbered per (group, bucket); bucket offsets are running sums over the bucket counts, a
    table with one row per bucket. Buckets have to be bounded: a fixed id width for unique ids.
    """
    buckets = df.withColumn("_bucket", bucket)
    if not group:
        buckets = buckets.withColumn("_all", F.lit(0))
    keys = list(group) or ["_all"]
    counts = buckets.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        buckets.withColumn("_local", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_offset", "_local", "_all")
    )


def index_by_id(df: DataFrame, id_column: str, out: str = "triplet_row_index", width: int = 4096) -> DataFrame:
    """Row index in ascending order of a unique integer id; a bucket holds at most ``width`` ids."""
    return dense_index(df, [], F.floor(F.col(id_column) / F.lit(width)), [id_column], out)
