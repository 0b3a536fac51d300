import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave import checks
from voxelweave.functions.stats import index_by_id
from voxelweave.operators import features
from voxelweave.sources import vectors

DIMS = 5
DRAWN = np.random.default_rng(8).normal(size=(2, 3, 2, DIMS)).astype(np.float32)
OUTPUT, FFN = [dict(zip(("EN", "FR", "ZH"), table)) for table in DRAWN]


def state_table(spark, drop=()):
    rows = [
        ("xlmr", lang, state, 0, 0.0, i, [float(v) for v in vec])
        for state, table in (("OUTPUT", OUTPUT), ("FFN", FFN)) for lang, vecs in table.items() for i, vec in enumerate(vecs) if (state, lang, i) not in drop
    ]
    return spark.createDataFrame(rows, "model string, language string, state string, block int, block_depth_norm double, triplet_row_index bigint, vec array<float>")


def test_shared_specific_full(spark):
    got = {
        (r.state, r.target_language, r.condition, r.triplet_row_index): np.array(r.vec)
        for r in features.build_features(state_table(spark), include_full=True).collect()
    }
    for state, table in (("OUTPUT", OUTPUT), ("FFN", FFN)):
        for target in ("EN", "FR", "ZH"):
            a, b = [np.array(table[x], float) for x in ("EN", "FR", "ZH") if x != target]
            shared = (a + b) / 2
            gap = np.array(table[target], float) - shared
            specific = gap - ((shared * gap).sum(1) / ((shared**2).sum(1) + 1e-8))[:, None] * shared
            for i in range(2):
                assert np.allclose(got[state, target, "SHARED", i], shared[i], atol=1e-6)
                assert np.allclose(got[state, target, "SPECIFIC", i], specific[i], atol=1e-6)
                assert np.allclose(got[state, target, "FULL", i], np.r_[shared[i], specific[i]], atol=1e-6)
                assert abs(np.dot(got[state, target, "SHARED", i], got[state, target, "SPECIFIC", i])) < 1e-6
    assert ("OUTPUT", "EN", "RAW", 0) in got and ("FFN", "EN", "RAW", 0) not in got


def test_incomplete_groups_are_reported(spark):
    shapes = checks.vector_group_shapes(state_table(spark, drop={("FFN", "ZH", 1)}), ["model", "block", "state"], ("EN", "FR", "ZH"))
    assert {r.state: r.complete for r in shapes.collect()} == {"OUTPUT": True, "FFN": False}


def test_derangements_across_buckets(spark):
    rows = spark.range(3000).select(F.lit("EN").alias("language"), (F.col("id") % 2).cast("int").alias("canonical_run"), F.col("id").alias("triplet_row_index"))
    got = features.shuffle_permutations(rows, 2, 11).toPandas()
    for (_, run), part in got.groupby(["shuffle_index", "canonical_run"]):
        assert (part.triplet_row_index != part.permuted_row_index).all()
        assert set(part.triplet_row_index) == set(part.permuted_row_index) and (part.permuted_row_index % 2 == run).all()
    a, b = [got[got.shuffle_index == i].set_index("triplet_row_index").permuted_row_index for i in (0, 1)]
    assert (a != b.reindex(a.index)).mean() > 0.9
    lone = spark.createDataFrame([("EN", 1, 0), ("EN", 2, 1), ("EN", 2, 2)], "language string, canonical_run int, triplet_row_index bigint")
    assert [r.canonical_run for r in features.singleton_runs(lone).collect()] == [1]


def test_mismatched_replaces_earlier_rows(spark):
    feats = features.build_features(state_table(spark))
    perm = features.shuffle_permutations(
        feats.where("condition = 'SHARED' AND state = 'OUTPUT'").select(F.col("target_language").alias("language"), F.lit(1).alias("canonical_run"), "triplet_row_index"), 3, 5
    )
    fresh = features.mismatched_shared(feats, perm)
    once = features.refresh_mismatched(feats.withColumn("shuffle_index", F.lit(None).cast("int")), fresh)
    twice = features.refresh_mismatched(once, fresh)
    assert once.count() == twice.count() == feats.count() + 2 * 3 * 3 * 2


def test_mutated_vector_falls_back(spark):
    states = state_table(spark).where("state = 'OUTPUT'")
    requests = spark.createDataFrame([("a", 0), ("b", 1)], "request string, triplet_row_index bigint")
    encoded = spark.createDataFrame([("a", 0, "FR", [9.0] * DIMS)], "request string, triplet_row_index bigint, sentence_language string, vec array<double>")
    got = {r.request: r.vec for r in features.mutated_shared(requests, encoded, states, "EN").collect()}
    np.testing.assert_allclose(got["a"], (9 + OUTPUT["ZH"][0].astype(float)) / 2, atol=1e-6)
    np.testing.assert_allclose(got["b"], (OUTPUT["FR"][1].astype(float) + OUTPUT["ZH"][1]) / 2, atol=1e-6)


def test_pooling_and_empty_mask(spark):
    rows = [("s", True, True, [9.0, 9.0]), ("s", True, False, [1.0, 3.0]), ("s", True, False, [3.0, 1.0]), ("s", False, False, [7.0, 7.0]), ("e", True, True, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "k string, attended boolean, special boolean, vec array<double>")
    got = {r.k: (r.n_tokens_pooled, r.vec) for r in features.pool_tokens(df, ["k"], normalise=False).collect()}
    assert got == {"s": (2, [2.0, 2.0]), "e": (0, [0.0, 0.0])}
    unit = {r.k: r.vec for r in features.pool_tokens(df, ["k"]).collect()}
    assert np.allclose(unit["s"], [np.sqrt(0.5)] * 2) and unit["e"] == [0.0, 0.0]


def test_each_text_is_encoded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encode(language, texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([("EN", "ab", i) for i in range(5)] + [("EN", "abc", 9), ("FR", "ab", 8)], "language string, text string, i int")
    got = features.encode_distinct(rows, features.pandas_encoder(encode)).collect()
    assert calls.value == 3 and {(r.i, r.vec[0]) for r in got} == {(i, 2.0) for i in range(5)} | {(9, 3.0), (8, 2.0)}


def test_half_precision(spark):
    df = spark.createDataFrame([([0.1, 1000.3],)], "vec array<float>")
    got = df.select(features.reduced_precision(F.col("vec"), "float16").alias("v")).first().v
    assert got == [float(np.float16(0.1)), float(np.float16(1000.3))]
    with pytest.raises(ValueError):
        features.reduced_precision(F.col("vec"), "int8")


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_packing_equals_the_sequential_rule(spark, chunk):
    rng = np.random.default_rng(chunk)
    lengths = rng.integers(0, 14, 60)
    df = spark.createDataFrame([("k", i, int(n)) for i, n in enumerate(lengths)], "k string, pos bigint, n int")
    want, fill, batch = [], 0, 0
    for n in lengths:
        cost = max(1, int(n))
        if fill and fill + cost > 10:
            batch, fill = batch + 1, 0
        fill += cost
        want.append(batch)
    got = features.pack_batches(df, ["k"], "pos", "n", 10, chunk_rows=chunk).orderBy("pos").toPandas()
    assert got["batch_index"].tolist() == want


def test_npy_files(spark, tmp_path):
    matrix = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.save(tmp_path / "block_00.npy", matrix)
    got = vectors.read_npy(spark, str(tmp_path)).orderBy("row_index").toPandas()
    assert np.array_equal(np.stack(got["vec"]), matrix.astype(np.float32))


def test_vector_differences(spark):
    a = spark.createDataFrame([("m", 0, [1.0, 2.0]), ("m", 1, [0.0, 0.0])], "model string, i int, vec array<double>")
    b = spark.createDataFrame([("m", 0, [1.0, 2.5]), ("m", 1, [0.0, 0.1])], "model string, i int, vec array<double>")
    got = features.vector_differences(a, b, ["model", "i"], ["model"]).first()
    assert got.mean_abs_diff == pytest.approx(0.15) and got.max_abs_diff == 0.5
    assert pd.notna(got.model)


def test_digest_encoder_equals_plain_sums(spark):
    texts = ["", " le chat\tdort\r\n le\x0bchat ", "甲 乙", None]
    got = [list(r.vec) for r in features.digest_encoder(3)(spark.createDataFrame([("FR", t) for t in texts], "language string, text string").coalesce(1)).collect()]
    for text, vec in zip(texts[:3], got):
        words = [w for w in re.split(r"[ \t\r\n]+", text) if w]
        mean = np.array([sum((int(hashlib.sha256(w.encode()).hexdigest()[i], 16) - 7.5) / 7.5 for w in words) / max(len(words), 1) for i in range(3)])
        assert np.allclose(vec, mean / max(np.linalg.norm(mean), 1e-8), atol=1e-15)
    assert got[3] == [None] * 3


def test_row_index_uses_several_tasks(spark):
    rows = spark.range(30_000).withColumn("text", F.expr("repeat(uuid(), 20)"))
    tasks = index_by_id(rows, "id", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 30_000
