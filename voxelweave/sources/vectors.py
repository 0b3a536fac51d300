"""Vector matrices: import of .npy files, and the native parquet vector table."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def decode_npy(files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Rows of every matrix in a (keys.., content BINARY) table: (keys.., row_index, vec).

    A file is one (model, language, state, block) matrix; its rows leave the task in slices.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                matrix = np.load(io.BytesIO(row.content), allow_pickle=False).astype(np.float32, copy=False)
                for start in range(0, len(matrix), 4096):
                    part = matrix[start : start + 4096]
                    out = pd.DataFrame({"row_index": np.arange(start, start + len(part), dtype=np.int64), "vec": list(part)})
                    for k in keys:
                        out[k] = getattr(row, k)
                    yield out[[*keys, "row_index", "vec"]]

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", row_index bigint, vec array<float>"
    return files.select(*keys, "content").mapInPandas(run, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return decode_npy(files.select("path", "content"))


def encode_npy(rows: DataFrame, keys: Sequence[str], slice_rows: int = 4096) -> DataFrame:
    """.npy bytes per (keys, slice of rows), for exchange with array tools; a slice holds ``slice_rows`` rows."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_index")
        buffer = io.BytesIO()
        np.save(buffer, np.stack(pdf["vec"].to_list()).astype(np.float32))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "first_row": [int(pdf["row_index"].iloc[0])], "content": [buffer.getvalue()]})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", first_row bigint, content binary"
    sliced = rows.select(*keys, "row_index", "vec", F.floor(F.col("row_index") / F.lit(slice_rows)).alias("_slice"))
    return sliced.groupBy(*keys, "_slice").applyInPandas(pack, schema)


def vector_catalogue(vectors: DataFrame, keys: Sequence[str], bytes_per_value: int = 4) -> DataFrame:
    """One catalogue row per key: rows, width and payload size."""
    return vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("vec")).alias("feature_dim"),
        (F.sum(F.size("vec")) * bytes_per_value).cast("bigint").alias("payload_bytes"),
    )
