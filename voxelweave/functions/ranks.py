"""Exact ranks and running values inside groups of any size and skew.

Rows are dealt into ranges of (group, order) whose limits Spark samples, so ranges hold about equally many rows whatever the
groups and values look like: a giant group is spread over many ranges, and many small groups share one. A running value is the one
inside a range plus what the earlier ranges of the group add up to, a table with one row per group and range.

The dealt rows are written once: the number of a row's range must not be drawn again when a task is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.session import cut

RANGE = "_range"


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` with the number of its range. Ties of ``order`` stay together, so it should tell most rows apart."""
    how = [*group, *order]
    dealt = df.repartitionByRange(parts, *how) if parts else df.repartitionByRange(*how)
    return cut(dealt.withColumn(RANGE, F.spark_partition_id()))


def running(dealt: DataFrame, group: Sequence[str], order: Sequence[str | Column], **measures: tuple[str, Column]) -> DataFrame:
    """Running ``sum`` or ``max`` of columns up to and including each row, in the order that ``dealt`` was dealt by.

    ``measures``: name=(kind, column). Rows with a null group key drop out. Sums start at 0, maxima at the first value.
    """
    keys = [*group, RANGE]
    kinds = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys).agg(*[kinds[kind](column).alias(f"_t_{name}") for name, (kind, column) in measures.items()])
    earlier = totals.select(*keys, *[kinds[kind](f"_t_{name}").over(before).alias(f"_e_{name}") for name, (kind, _) in measures.items()])
    here = dealt.select("*", *[kinds[kind](column).over(inside).alias(f"_h_{name}") for name, (kind, column) in measures.items()])
    joined = here.join(earlier, keys)
    out = {}
    for name, (kind, _) in measures.items():
        now, past = F.col(f"_h_{name}"), F.col(f"_e_{name}")
        out[name] = now + F.coalesce(past, F.lit(0)) if kind == "sum" else F.greatest(now, past)  # greatest skips null
    return joined.withColumns(out).drop(*[f"_{k}_{name}" for k in "he" for name in measures])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str, parts: int | None = None) -> DataFrame:
    """0-based position of every row in the ``order`` of its group."""
    return running(in_ranges(df, group, order, parts), group, order, **{out: ("sum", F.lit(1).cast("bigint"))}).withColumn(out, F.col(out) - 1).drop(RANGE)


def holm(df: DataFrame, p: str = "p_raw", out: str = "p_holm", family: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Holm step-down over all tests of a family (of the table without one): min(1, running max of p (m - rank + 1)).

    Equal p are told apart by a hash of the row; their order does not change the result.
    """
    keys = list(family) or ["_family"]
    rows = df if family else df.withColumn("_family", F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    order = [p, "_tie"]
    dealt = in_ranges(rows.join(sizes, keys).withColumn("_tie", F.xxhash64(*df.columns)), keys, order, parts)
    steps = running(dealt, keys, order, _rank=("sum", F.lit(1).cast("bigint"))).withColumn("_step", F.col(p) * (F.col("_m") - F.col("_rank") + 1))
    done = running(steps, keys, [p, "_rank"], _top=("max", F.col("_step")))
    return done.select(*df.columns, F.least(F.lit(1.0), "_top").alias(out))


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], parts: int | None = None) -> DataFrame:
    """Percentiles with linear interpolation; equal values collapse into counts before they are ranked."""
    group = list(group)
    tallied = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ends = running(in_ranges(tallied, group, ["_v"], parts), group, ["_v"], _end=("sum", F.col("_c")))
    placed = ends.join(tallied.groupBy(*group).agg(F.sum("_c").alias("_n")), group)
    start, end = F.col("_end") - F.col("_c"), F.col("_end")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col("_v")))

    out = []
    for name, share in probs.items():
        position = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(position)
        lower, upper = at(low), at(F.least(low + 1, F.col("_n") - 1))
        out.append((lower + (upper - lower) * F.max(position - low)).alias(name))
    return placed.groupBy(*group).agg(*out)
