"""Expressions and joins that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelweave.session import work_path

# Largest number of rows of a few scalars that is ever broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 400_000
# The same for rows with strings: the largest sum of their sizes.
BROADCAST_BYTES = 32 << 20

# Bytes of one Arrow batch between Spark and a Python worker. Executor and worker hold a batch several times over, off the heap, and keep
# what they took for later tasks; by Spark's own bounds (10,000 rows, 64 MB) a batch of texts is a whole partition.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound this session's Arrow batches to about ``size`` bytes; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fold(doc_id: Column | str, folds: int = 3) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def ascii_lower(text: Column) -> Column:
    """A-Z only, so that every engine agrees whatever its Unicode tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back: computed once, columns still prunable,
    and a lost executor costs no more than the tasks it ran."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it was counted and found to have at most ``rows`` rows, else unchanged (a shuffle join).
    Give a stored table of a few scalars, so that the count reads footers only."""
    return F.broadcast(small) if small.count() <= rows else small.hint("merge")


def sized_text(small: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """As ``sized`` for rows with strings of any length: the bytes of their strings and 40 for every column and row are summed."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in small.dtypes if kind == "string"), F.lit(40 * len(small.columns)))
    total = small.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= size else small.hint("merge")


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stored tables of one run in a folder of their own, which ``clear`` deletes when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.count = spark, work_path(spark, name), 0

    def stored(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        df.write.parquet(path, **options)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
