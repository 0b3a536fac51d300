"""Table sinks: sorted parquet, vector tables, report CSV, event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_sorted(df: DataFrame, path: str, sort_columns: Sequence[str], *, partition_by: Sequence[str] = (), nulls_first: bool = False) -> str:
    """Globally ordered parquet: ranges of the sort key, ordered inside each file."""
    order = [F.col(c).asc_nulls_first() if nulls_first else F.col(c).asc_nulls_last() for c in sort_columns]
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_vectors(df: DataFrame, path: str, partition_by: Sequence[str] = ("model", "state")) -> str:
    """Vector table partitioned by the keys that scans filter on."""
    df.sortWithinPartitions("triplet_row_index").write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_report(df: DataFrame, path: str, sort_columns: Sequence[str], sep: str = ",") -> str:
    """Report table (a few rows per setting) as one CSV file with a header."""
    df.orderBy(*sort_columns).coalesce(1).write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)
    return path


def append_events(df: DataFrame, path: str) -> str:
    """Append progress or decision events as JSON lines."""
    df.write.mode("append").json(path)
    return path
