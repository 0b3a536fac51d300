"""Confirmatory contrasts: sign-flip tests, bootstrap intervals, Holm correction.

Randomness is a hash of (seed, cell, unit, block), so every row draws its own signs on whatever
executor it lies, a retry repeats them, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelweave.checks import axis, coverage_gaps, demand_empty
from voxelweave.functions.digests import numbered_md5
from voxelweave.functions.ranks import holm, ranked
from voxelweave.functions.stats import stable_offset
from voxelweave.functions.vector import lane_sums, lane_values
from voxelweave.operators.effects import subject_family_deltas
from voxelweave.schemas import ATTENTION_STATES, FEEDFORWARD_STATES, H1, H2
from voxelweave.session import cut, spread

CELL = ["model", "language", "hypothesis"]
FLIPS_PER_HASH = 32
DRAWS_PER_BLOCK = 256
CELLS_PER_TASK = 256  # cells whose sums a task keeps before it hands them on
HASHES_AT_ONCE = 65536
ROWS_AT_ONCE = 64
PIECE, SLICE = 65536, 1 << 22  # effects of a cell in one packed row, and in one task


def contrasts(family_deltas: DataFrame) -> DataFrame:
    """Per subject: mean delta of the favoured states minus the others, subjects with both sides only."""
    semantic, auditory = F.col("roi_family") == "SEMANTIC", F.col("roi_family") == "AUDITORY"
    hypothesis = F.when(semantic, H1).when(auditory, H2)
    attention = F.col("state").isin(*ATTENTION_STATES)
    feedforward = F.col("state").isin(*FEEDFORWARD_STATES)
    positive = (semantic & feedforward) | (auditory & attention)
    negative = (semantic & attention) | (auditory & feedforward)
    return (
        family_deltas.where(semantic | auditory)
        .groupBy("model", "language", hypothesis.alias("hypothesis"), "subject_id")
        .agg(
            F.avg(F.when(positive, F.col("delta_z"))).alias("positive_mean"),
            F.avg(F.when(negative, F.col("delta_z"))).alias("negative_mean"),
        )
        .where("positive_mean IS NOT NULL AND negative_mean IS NOT NULL")
        .withColumn("effect_value", F.col("positive_mean") - F.col("negative_mean"))
    )


def effect_summary(effects: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Mean, standard error and dz; a single subject or no spread gives sd 0 and dz 0."""
    n, sd = F.col("n_subjects"), F.col("_sd")
    return (
        effects.groupBy(*cell)
        .agg(
            F.avg("effect_value").alias("effect_mean"),
            F.count(F.lit(1)).alias("n_subjects"),
            F.coalesce(F.stddev_samp("effect_value"), F.lit(0.0)).alias("_sd"),
        )
        .withColumn("se", sd / F.sqrt(n))
        .withColumn("dz", F.when(sd > 0, F.col("effect_mean") / sd).otherwise(F.lit(0.0)))
        .drop("_sd")
    )


def _flip_sums(cell: Sequence[str], blocks: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per cell and hash block: number of effects and the sums under its 32 sign patterns, over the rows of a partition."""

    def release(sums: dict) -> pa.RecordBatch:
        rows = [(*key, block, n, lanes) for key, (n, total) in sums.items() for block, lanes in enumerate(total.reshape(blocks, -1))]
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                *keys, prefixes, values = [c.to_pylist() for c in batch.slice(first, ROWS_AT_ONCE).columns]
                # The first bit of a hex digit tells whether it is 8 or more.
                signs = np.unpackbits(numbered_md5([p.encode() for p in prefixes], range(blocks)).reshape(-1, 1) & 136, axis=1)[:, ::4]
                signs, values = signs.reshape(len(prefixes), -1), np.array(values)
                places: dict = {}
                for row, key in enumerate(zip(*keys)):
                    places.setdefault(key, []).append(row)
                for key, rows in places.items():
                    n, total = sums.get(key, (0, 0.0))
                    v = values[rows]
                    sums[key] = (n + len(v), total + 2.0 * (v @ signs[rows].astype(np.float64)) - v.sum())
                if len(sums) >= CELLS_PER_TASK:
                    yield release(sums)
                    sums = {}
        if sums:
            yield release(sums)

    return run


def sign_flip_draws(effects: DataFrame, permutations: int, seed: int, cell: Sequence[str] = CELL) -> DataFrame:
    """Mean effect of every permutation: one md5 gives 32 signs.

    A task adds the signed effects of its rows up for all permutations, so that only sums by cell and hash block are shuffled.
    """
    blocks = (permutations - 1) // FLIPS_PER_HASH + 1
    key = F.concat_ws("|", F.lit(str(seed)), *cell, F.lit("perm"), F.col("subject_id").cast("string"), F.lit(""))
    rows = spread(effects.where("effect_value IS NOT NULL"), *cell, "subject_id").select(*cell, key.alias("_key"), F.col("effect_value").cast("double").alias("_value"))
    schema = T.StructType([*[rows.schema[c] for c in cell], *T.StructType.fromDDL("hash_block int, n bigint, sums array<double>")])
    parts = rows.mapInArrow(_flip_sums(cell, blocks, to_arrow_schema(schema)), schema)
    totals = parts.groupBy(*cell, "hash_block").agg(F.sum("n").alias("n"), *lane_sums(F.col("sums"), FLIPS_PER_HASH))
    flips = totals.select(*cell, "hash_block", "n", F.posexplode(lane_values(FLIPS_PER_HASH)).alias("position", "total"))
    draw = F.col("hash_block") * FLIPS_PER_HASH + F.col("position")
    return flips.where(draw < permutations).select(*cell, draw.alias("draw"), (F.col("total") / F.col("n")).alias("permuted_mean"))


def sign_flip_test(effects: DataFrame, permutations: int, seed: int, cell: Sequence[str] = CELL, decimals: int = 12) -> DataFrame:
    """One-sided p = (1 + #{permuted >= observed}) / (1 + P), with mean and sd of the draws.

    Both sides are rounded before comparing: a draw that flips nothing has to count as equal.
    """
    observed = effects.groupBy(*cell).agg(F.avg("effect_value").alias("observed_mean"), F.count(F.lit(1)).alias("n_subjects"))
    draws = sign_flip_draws(effects, permutations, seed, cell)
    reached = (F.round("permuted_mean", decimals) >= F.round("observed_mean", decimals)).cast("bigint")
    return (
        draws.join(observed, list(cell))
        .groupBy(*cell)
        .agg(
            F.first("observed_mean").alias("observed_mean"),
            F.avg("permuted_mean").alias("permuted_mean"),
            F.coalesce(F.stddev_samp("permuted_mean"), F.lit(0.0)).alias("permuted_std"),
            ((F.lit(1) + F.sum(reached)) / F.lit(1.0 + permutations)).alias("p_raw"),
            F.first("n_subjects").alias("n_subjects"),
        )
    )


def _resample_sums(cell: Sequence[str], bootstraps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums over the picks of one block of draws that fall into one slice of a cell's effects."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_piece")
        head = pieces.iloc[0]
        values, n, first = np.concatenate(list(pieces["_values"])), int(head["n"]), int(head["_slice"]) * SLICE
        draws = range(int(head["_block"]) * DRAWS_PER_BLOCK, min((int(head["_block"]) + 1) * DRAWS_PER_BLOCK, bootstraps))
        fours = (n + 3) // 4
        step = max(1, HASHES_AT_ONCE // fours)
        sums = np.zeros(len(draws))
        for first_draw in range(0, len(draws), step):
            keys = [f"{head['_key']}|{draw}|".encode() for draw in draws[first_draw : first_draw + step]]
            for start in range(0, fours, HASHES_AT_ONCE):
                end = min(fours, start + HASHES_AT_ONCE)
                words = numbered_md5(keys, range(start, end)).view(">u4").reshape(len(keys), -1)[:, : n - 4 * start]
                picks = words.astype(np.int64) % n - first
                if len(values) < n:
                    inside = (picks >= 0) & (picks < len(values))
                    found = np.where(inside, values[np.where(inside, picks, 0)], 0.0)
                else:
                    found = values[picks]
                sums[first_draw : first_draw + step] += found.sum(axis=1)
        return pd.DataFrame({**{c: [head[c]] * len(draws) for c in cell}, "draw": list(draws), "n": n, "total": sums})

    return run


def bootstrap_draws(effects: DataFrame, bootstraps: int, seed: int, cell: Sequence[str] = CELL) -> DataFrame:
    """Means of resamples with replacement: n hashed positions per draw, looked up by dense index.

    Blocks of draws are dealt over the executors, each with the effects of its cell as packed pieces of ``PIECE`` values; one hash
    gives four positions, and a draw leaves the task as one sum. No pick is a row. A task holds at most ``SLICE`` effects: a larger
    cell is dealt by slices too, and each adds up the picks that fall into it. The index comes from sampled ranges of equal depth.
    """
    known = effects.where("effect_value IS NOT NULL")
    shuffled = known.select(*cell, "subject_id", F.col("effect_value").cast("double").alias("effect_value"), F.substring(F.md5(F.col("subject_id").cast("string")), 1, 2).alias("_order"))
    indexed = ranked(shuffled, cell, ["_order", "subject_id"], "slot")
    packed = indexed.groupBy(*cell, F.floor(F.col("slot") / PIECE).alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("slot", "effect_value"))).alias("_rows"))
    pieces = cut(packed.select(*cell, "_piece", F.floor(F.col("_piece") * PIECE / SLICE).alias("_slice"), F.col("_rows.effect_value").alias("_values")))
    sizes = pieces.groupBy(*cell).agg(F.sum(F.size("_values")).alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((bootstraps - 1) // DRAWS_PER_BLOCK))).alias("_block")
    key = F.concat_ws("|", F.lit(str(seed)), *cell, F.lit("boot")).alias("_key")
    dealt = pieces.join(sizes, list(cell)).select(*cell, key, "n", "_slice", "_piece", "_values", blocks)
    task = [*cell, "_block", "_slice"]
    schema = T.StructType([*[dealt.schema[c] for c in cell], *T.StructType.fromDDL("draw int, n bigint, total double")])
    sums = spread(dealt, *task).groupBy(*task).applyInPandas(_resample_sums(cell, bootstraps), schema)
    return sums.groupBy(*cell, "draw").agg((F.sum("total") / F.first("n")).alias("sample_mean"))


def bootstrap_interval(effects: DataFrame, bootstraps: int, seed: int, cell: Sequence[str] = CELL) -> DataFrame:
    """Percentile interval (2.5, 97.5) with exact linear interpolation, plus mean and sd of the draws."""
    sizes = effects.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_subjects"))
    return (
        bootstrap_draws(effects, bootstraps, seed, cell)
        .groupBy(*cell)
        .agg(
            F.percentile("sample_mean", F.lit(0.025)).alias("ci_low"),
            F.percentile("sample_mean", F.lit(0.975)).alias("ci_high"),
            F.avg("sample_mean").alias("bootstrap_mean"),
            F.coalesce(F.stddev_samp("sample_mean"), F.lit(0.0)).alias("bootstrap_std"),
        )
        .join(sizes, list(cell))
    )


def numpy_draws(effects: DataFrame, permutations: int, bootstraps: int, seed: int) -> DataFrame:
    """The study's own generator draws, one cell (a cohort of subjects) per group.

    NumPy's stream ties every draw to the whole ordered cohort, so a cell is one group here. Use it to
    reproduce published numbers; the hashed draws above are the ones that scale with the cohort.
    """
    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("subject_id")
        x = cell["effect_value"].to_numpy(dtype=np.float64)
        flips = np.random.default_rng(int(cell["perm_seed"].iloc[0])).choice(np.array([-1.0, 1.0]), size=(permutations, x.size))
        means = (flips * x).mean(axis=1)
        picks = np.random.default_rng(int(cell["boot_seed"].iloc[0])).integers(0, x.size, size=(bootstraps, x.size))
        low, high = np.quantile(x[picks].mean(axis=1), [0.025, 0.975])
        p = (1 + int((means >= x.mean()).sum())) / (1 + permutations)
        return pd.DataFrame([{**{c: cell[c].iloc[0] for c in CELL}, "p_raw": p, "ci_low": low, "ci_high": high}])

    perm = stable_offset(F.concat_ws("|", "model", "language", "hypothesis", F.lit("perm"))) + seed
    boot = stable_offset(F.concat_ws("|", "hypothesis", "language", "model", F.lit("boot"))) + seed + 17
    schema = "model string, language string, hypothesis string, p_raw double, ci_low double, ci_high double"
    return effects.withColumn("perm_seed", perm).withColumn("boot_seed", boot).groupBy(*CELL).applyInPandas(solve, schema)


def primary_effects(
    effects: DataFrame, *, permutations: int = 10000, bootstraps: int = 10000, seed: int = 1337, mode: str = "hash"
) -> DataFrame:
    """The summary table of all cells: effect, interval, p, Holm p, se, dz."""
    effects = cut(effects)  # read by the summary, the test and the interval
    summary = effect_summary(effects)
    if mode == "numpy":
        tested = summary.join(numpy_draws(effects, permutations, bootstraps, seed), CELL)
    else:
        test = sign_flip_test(effects, permutations, seed).select(*CELL, "p_raw")
        interval = bootstrap_interval(effects, bootstraps, seed).select(*CELL, "ci_low", "ci_high")
        tested = summary.join(test, CELL).join(interval, CELL)
    return (
        holm(tested)
        .withColumn("permutation_count", F.lit(permutations).cast("bigint"))
        .withColumn("bootstrap_count", F.lit(bootstraps).cast("bigint"))
        .select(
            *CELL, "effect_mean", "ci_low", "ci_high", "p_raw", "p_holm", "n_subjects",
            "permutation_count", "bootstrap_count", "se", "dz",
        )
    )


def primary_coverage_gaps(summary: DataFrame, models: Sequence[str], languages: Sequence[str]) -> DataFrame:
    spark = summary.sparkSession
    expected = (
        axis(spark, "model", [m.lower() for m in models])
        .join(axis(spark, "language", [c.upper() for c in languages]))
        .join(axis(spark, "hypothesis", [H1, H2]))
    )
    observed = summary.select(F.lower("model").alias("model"), F.upper("language").alias("language"), "hypothesis")
    return coverage_gaps(observed, expected, CELL)


def run_primary_tests(
    subject_results: DataFrame, models: Sequence[str], languages: Sequence[str], **options
) -> dict[str, DataFrame]:
    """Effects, contrasts, tests and the coverage check; raises when a cell is missing or extra."""
    effects = contrasts(subject_family_deltas(subject_results))
    summary = primary_effects(effects, **options)
    demand_empty(primary_coverage_gaps(effects.select(*CELL).distinct(), models, languages), "Primary test coverage")
    return {"summary": summary, "subject_effects": effects}
