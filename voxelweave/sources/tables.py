"""Table scans: parquet with must-exist check, delimiter-sniffing CSV, tagged shards, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voxelweave.checks import ContractError

DELIMITERS = (",", "\t", ";", "|")


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a Hadoop glob; works on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found) if found is not None else []


def require_paths(spark: SparkSession, paths: Sequence[str], shown: int = 3) -> None:
    missing = [p for p in paths if not _matches(spark, p)]
    if missing:
        more = f" ... (+{len(missing) - shown} more)" if len(missing) > shown else ""
        raise FileNotFoundError(f"Missing tables: {', '.join(missing[:shown])}{more}")


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet scan; column selection reaches the file reader."""
    require_paths(spark, [path])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with the delimiter that occurs most often in the header line."""
    require_paths(spark, [path])
    header = spark.read.text(path).first()
    line = header[0] if header is not None else ""
    delimiter = max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))
    return spark.read.option("header", True).option("sep", delimiter).option("enforceSchema", False).schema(schema).csv(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines event table."""
    return spark.read.schema(schema).json(path)


def tagged(path: str, tag: str | None) -> str:
    """name.ext -> name__tag.ext"""
    if not tag:
        return path
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}__{tag}.{suffix}" if dot and "/" not in suffix else f"{path}__{tag}"


def shard_paths(
    spark: SparkSession, path: str, *, listed: Sequence[str] | None = None, patterns: Sequence[str] | None = None
) -> list[str]:
    """Shards of a table: exactly the listed ones (all must exist), those matching patterns, or all tagged siblings."""
    if listed is not None:
        if not listed:
            raise ContractError("The shard manifest lists no shards.")
        require_paths(spark, listed)
        return list(listed)
    found: list[str] = []
    for pattern in patterns or [tagged(path, "*")]:
        found += _matches(spark, pattern)
    if not found:
        raise FileNotFoundError(f"No shards found for {path}")
    return list(dict.fromkeys(found))


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All shards as one scan, with the shard tag taken from the file path."""
    tag = F.regexp_extract(F.col("_metadata.file_path"), r"__([^/.]+)", 1)
    df = spark.read.parquet(*paths)
    return df.select("*", tag.alias("shard_tag"))
