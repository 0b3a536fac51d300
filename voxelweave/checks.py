"""Table contracts: columns, keys, grids and shapes.

Each ``*_violations`` function returns a DataFrame of offending rows; ``demand_empty``
turns it into an error and brings at most a few examples to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(RuntimeError):
    """A table does not meet its contract."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks required columns: {', '.join(missing)}")
    return df


def demand_empty(violations: DataFrame, label: str, shown: int = 3) -> None:
    sample = violations.limit(shown + 1).collect()
    if sample:
        preview = [row.asDict() for row in sample[:shown]]
        raise ContractError(f"{label}: {preview}{' ...' if len(sample) > shown else ''}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def grid(df_by_axis: Sequence[DataFrame]) -> DataFrame:
    """Expected cells as the product of small axis tables (distinct codes, never fact rows)."""
    cells = df_by_axis[0]
    for axis in df_by_axis[1:]:
        cells = cells.join(axis)
    return cells


def axis(spark, name: str, values: Sequence) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def coverage_gaps(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells missing from, or extra to, the expected grid; empty when both sides agree."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(1))
    wanted = expected.select(*keys).distinct().withColumn("_wanted", F.lit(1))
    return (
        wanted.join(seen, list(keys), "full")
        .where(F.col("_seen").isNull() | F.col("_wanted").isNull())
        .select(*keys, F.when(F.col("_seen").isNull(), "missing").otherwise("extra").alias("gap"))
    )


def multi_valued(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose rows disagree on a value that has to be single (for example scans per run)."""
    return (
        df.groupBy(*keys)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .where(F.col("low") != F.col("high"))
    )


def missing_cells(observed: DataFrame, rows: DataFrame, columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row entity needs every column entity (for example every subject all runs of its language)."""
    return rows.join(columns).select(*keys).join(observed.select(*keys).distinct(), list(keys), "left_anti")


def vector_group_shapes(states: DataFrame, keys: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Languages present, rows per language and vector widths of each group, with a verdict.

    Counting happens per (group, language) first, so one large group never lands in one task.
    """
    per_language = states.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")
    )
    complete = (
        (F.col("n_languages") == len(languages))
        & (F.col("min_rows") == F.col("max_rows"))
        & (F.col("min_width") == F.col("max_width"))
    )
    return (
        per_language.groupBy(*keys)
        .agg(
            F.sum(F.col("language").isin(*languages).cast("bigint")).alias("n_languages"),
            F.min("n").alias("min_rows"),
            F.max("n").alias("max_rows"),
            F.min("lo").alias("min_width"),
            F.max("hi").alias("max_width"),
        )
        .withColumn("complete", complete)
    )


def code(column: str | Column, codes: Mapping[str, str], default: Column | None = None) -> Column:
    """Map literal codes; unmapped values become ``default`` (NULL when none is given)."""
    col = F.col(column) if isinstance(column, str) else column
    out = None
    for key, value in codes.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None))


def ordered_distinct(values: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(values))


def choose_states(
    *, everything: bool, argument: Sequence[str] | None, configured: Sequence[str] | None, observed: Sequence[str]
) -> tuple[str, ...]:
    """Precedence of a state selection: everything observed, the argument, the configuration, what is observed."""
    if everything:
        return tuple(sorted(set(observed)))
    for source in (argument, configured):
        if source:
            return ordered_distinct([str(s).upper() for s in source])
    return tuple(sorted(set(observed)))


def in_scope(df: DataFrame, fold=F.upper, **allowed: Sequence[str] | None) -> DataFrame:
    """Keep rows whose columns are in the given lists, ignoring case; an empty list does not filter."""
    for column, values in allowed.items():
        if values:
            df = df.where(F.upper(column).isin(*[str(v).upper() for v in values]))
    return df
