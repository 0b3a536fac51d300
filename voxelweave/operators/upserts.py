"""Set-wise table maintenance: scoped replacement, exact-row replacement, shard unions, staleness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from voxelweave.checks import ContractError, coverage_gaps, demand_empty, duplicate_keys


def null_safe_anti(left: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``keys_df``; NULL keys match NULL keys."""
    right = keys_df.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(right, condition, "left_anti")


def upsert_scope(existing: DataFrame, incoming: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Drop existing rows whose scope occurs in the incoming table, then append the incoming rows."""
    return null_safe_anti(existing, incoming, scope).unionByName(incoming, allowMissingColumns=True)


REPLACE_KEYS = ("subject_id", "language", "model", "roi_name", "layer_index", "condition", "metric_name")


def replace_rows(
    prior: DataFrame, local: DataFrame, keys: Sequence[str] = REPLACE_KEYS, *, replace_acoustic_only: bool = False
) -> DataFrame:
    """Exact-key replacement; the acoustic-only condition stays untouched unless asked for."""
    if not replace_acoustic_only:
        local = local.where(F.col("condition") != "acoustic_only")
    return upsert_scope(prior, local, keys)


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    if not shards:
        raise ContractError("No shards were given.")
    return reduce(lambda a, b: a.unionByName(b), shards)


def merge_unique(shards: Sequence[DataFrame], keys: Sequence[str], label: str) -> DataFrame:
    """Union that fails when a key occurs twice."""
    merged = union_shards(shards)
    demand_empty(duplicate_keys(merged, keys), f"Duplicate {label} rows across shards")
    return merged


def merge_distinct(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return union_shards(shards).dropDuplicates(list(keys))


CONSOLIDATION_KEYS = {
    "state_manifest": (("model", "language", "state", "block"), True),
    "output_manifest": (("model", "language", "block"), True),
    "token_metadata": (("model", "language", "triplet_id"), True),
    "triplet_ids": (("triplet_id",), False),
    "state_qc": (("model", "language", "block", "state"), True),
}


def consolidate(shards: dict[str, Sequence[DataFrame]], triplets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Five shard families into five tables; triplet ids collapse, the others must be unique."""
    out = {}
    for name, (keys, unique) in CONSOLIDATION_KEYS.items():
        family = shards.get(name) or ()
        if family:
            out[name] = merge_unique(family, keys, name) if unique else merge_distinct(family, keys)
    if "triplet_ids" not in out and triplets is not None:
        out["triplet_ids"] = triplets.select("triplet_id")
    return out


def latest_by_priority(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Prioritised union: per key the row of the last table that has it."""
    tagged = [df.withColumn("source_priority", F.lit(i)) for i, df in enumerate(tables)]
    best = Window.partitionBy(*keys).orderBy(F.col("source_priority").desc())
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return merged.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def demand_languages(merged: DataFrame, manifest: DataFrame) -> None:
    """The merged shards and the shard manifest name the same languages."""
    gaps = coverage_gaps(
        merged.select(F.upper("language").alias("language")), manifest.select(F.upper("language").alias("language")), ["language"]
    )
    demand_empty(gaps, "Merged shards do not match the expected languages")


def table_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows in one table but not the other (as multisets); empty when the stored table is current.

    Rows count +1 or -1 by side, so each table is read once and one shuffle finds the surplus.
    """
    columns = expected.columns
    both = stored.select(*columns, F.lit(1).alias("_n")).unionByName(expected.select(*columns, F.lit(-1).alias("_n")))
    surplus = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "stored").otherwise("expected").alias("side")
    return surplus.select(*columns, side, F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_i")).drop("_i")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work left: cells of the todo grid without a finished row."""
    return null_safe_anti(todo, done, keys)
