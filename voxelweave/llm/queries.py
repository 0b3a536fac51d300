"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelweave.llm import (
    audio_features, collocations, compression_quality, decontamination, licences, line_winnowing, mixing, secrets, simhash_vptree, source_divergence,
    token_files, toxicity, url_templates,
)
from voxelweave.llm.common import tables

TOKENIZER = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash_vptree.near_duplicates(tables(spark, sf_dir)("documents"))


@query
def op7_decontamination(spark, sf_dir):
    table = tables(spark, sf_dir)
    return decontamination.contamination(table("documents"), table("benchmark"))


ORACLE["op7_decontamination"] = decontamination.ORACLE_SQL


@query
def op1_toxicity(spark, sf_dir):
    table = tables(spark, sf_dir)
    return toxicity.scores(table("documents"), toxicity.fit(table("documents"), table("labels")))


@query
def op5_source_mixing(spark, sf_dir):
    return mixing.mix(tables(spark, sf_dir)("documents"))


ORACLE["op5_source_mixing"] = mixing.ORACLE_SQL


@query
def op6_url_templates(spark, sf_dir):
    table = tables(spark, sf_dir)
    return url_templates.judge(table("pages"), table("labels"))


ORACLE["op6_url_templates"] = url_templates.oracle_sql()


@query
def op8_line_winnowing(spark, sf_dir):
    cleaned = line_winnowing.deduplicate_lines(tables(spark, sf_dir)("documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.md5("text").alias("text_md5"))


ORACLE["op8_line_winnowing"] = line_winnowing.ORACLE_SQL


@query
def op10_licence_scan(spark, sf_dir):
    return licences.scan(tables(spark, sf_dir)("documents"))


ORACLE["op10_licence_scan"] = licences.oracle_sql()


@query
def op2_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.token_index(tables(spark, sf_dir)("documents"), public_tokenizers.path(TOKENIZER))


@query
def op3_audio_features(spark, sf_dir):
    return audio_features.digest(audio_features.document_audio(tables(spark, sf_dir)("documents")))


@query
def op4_compression_quality(spark, sf_dir):
    table = tables(spark, sf_dir)
    return compression_quality.scores(table("documents"), compression_quality.fit(table("documents"), table("labels")))


@query
def op11_secret_novelty(spark, sf_dir):
    return secrets.digest(secrets.scan(tables(spark, sf_dir)("documents")))


@query
def op12_phrase_collocations(spark, sf_dir):
    return collocations.collocations(tables(spark, sf_dir)("documents"))


ORACLE["op12_phrase_collocations"] = collocations.ORACLE_SQL


@query
def op13_source_divergence(spark, sf_dir):
    return source_divergence.divergence(tables(spark, sf_dir)("documents"))


ORACLE["op13_source_divergence"] = source_divergence.ORACLE_SQL
