"""A training corpus from the table of documents: toxic texts go, one text of each near-duplicate group stays, contaminated
texts go, sources are mixed to their target weights, and token files are written.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); what a function returns is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents, the last one row per written document.

Awkward rows: null and empty texts pass the filters (all of them are near duplicates of one another, so one stays) and are
written as the end id alone; rows without an id pass and are taken once; repeated rows count once after the second stage.
Each stage is documented and tested with its operator. Stages that hand texts to Python workers bound the session's Arrow batches
(``bounded_batches``), since executors and workers that live through all stages keep the memory of the largest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import decontamination, mixing, near_copies, token_files, toxicity
from voxelweave.llm.common import bounded_batches, stored, tables

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.without_toxic(docs, tables(spark, sf_dir)("labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_copies.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, tables(spark, sf_dir)("benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    return token_files.token_index(docs, public_tokenizers.path(TOKENIZER), release=True, kept=150_000)  # workers here still hold memory of earlier stages


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Embeddings trained in numpy, fingerprints by XXH64 and a tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir)("documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
