import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.checks import ContractError
from voxelweave.functions import digests, ranks, stats
from voxelweave.operators import effects, features, inference

COHORTS = {"EN": 5, "FR": 6, "ZH": 7}
REGIONS = {"L_IFG": "SEMANTIC", "R_MTG": "SEMANTIC", "L_A1": "AUDITORY", "R_STG": "AUDITORY"}
FAVOURED = {"SEMANTIC": ("FFN", "OUTPUT"), "AUDITORY": ("ATTN", "POST_ATTN")}


def cohort_rows(seed=11):
    """Cohorts of different sizes; every subject has an advantage of own size in the states its family favours, over noise."""
    rng, rows = np.random.default_rng(seed), []
    for (language, size), model in itertools.product(COHORTS.items(), ("xlmr", "nllb")):
        for person in range(size):
            advantage = dict(zip(FAVOURED, rng.uniform(0.4, 1.3, 2)))
            for (region, family), block, state in itertools.product(REGIONS.items(), range(3), ("ATTN", "POST_ATTN", "FFN", "OUTPUT")):
                base, shift = rng.normal(0.1, 0.05), advantage[family] * (state in FAVOURED[family])
                for condition, z in (("SHARED", base + shift + rng.normal(0, 0.02)), ("SPECIFIC", base)):
                    rows.append((f"{language}{person}", language, model, block, block / 2, state, condition, region, family, z))
    return rows


COLUMNS = ["subject_id", "language", "model", "block", "block_depth_norm", "state", "condition", "roi", "roi_family", "z_mean"]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(pd.DataFrame(cohort_rows(), columns=COLUMNS)).cache()


def test_confirmatory_grid(results):
    out = inference.run_primary_tests(results, ["xlmr", "nllb"], ["EN", "FR", "ZH"], permutations=64, bootstraps=50, seed=7)
    summary = out["summary"].toPandas()
    assert len(summary) == 12 and out["subject_effects"].count() == 4 * sum(COHORTS.values())
    assert (summary["effect_mean"] > 0).all() and (summary["n_subjects"] == summary["language"].map(COHORTS)).all()
    # With five to seven subjects one draw in 32 to 128 flips nothing and reaches the observed mean.
    assert summary["p_raw"].between(1 / 65, 0.25).all() and (summary["p_holm"] >= summary["p_raw"]).all()
    assert (summary["ci_low"] <= summary["effect_mean"]).all() and (summary["ci_high"] >= summary["effect_mean"]).all()


def test_missing_language_is_an_error(results):
    with pytest.raises(ContractError):
        inference.run_primary_tests(
            results.where("language <> 'ZH'"), ["xlmr", "nllb"], ["EN", "FR", "ZH"], permutations=8, bootstraps=8
        )


def test_numpy_mode_draws(results):
    contrasts = inference.contrasts(effects.subject_family_deltas(results))
    got = inference.primary_effects(contrasts, permutations=100, bootstraps=60, seed=1337, mode="numpy").toPandas()
    cell = contrasts.where("model = 'xlmr' AND language = 'EN' AND hypothesis LIKE 'H1%'").orderBy("subject_id").toPandas()
    x = cell["effect_value"].to_numpy()
    key = "|".join(("xlmr", "EN", "H1_semantic_ffn_preference", "perm"))
    offset = sum((i + 1) * ord(c) for i, c in enumerate(key)) % 100_000
    signs = np.random.default_rng(1337 + offset).choice([-1.0, 1.0], size=(100, len(x)))
    p = (1 + ((signs * x).mean(axis=1) >= x.mean()).sum()) / 101
    row = got[(got.model == "xlmr") & (got.language == "EN") & got.hypothesis.str.startswith("H1")].iloc[0]
    assert row.p_raw == pytest.approx(p)


def test_hashed_draws_behave_like_draws(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0.1, 1.0, 40)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "language": "EN", "hypothesis": "h", "subject_id": [f"S{i}" for i in range(40)], "effect_value": values}))
    flips = inference.sign_flip_test(df, 4000, 1).first()
    exact = (1 + (np.random.default_rng(5).choice([-1, 1], (20000, 40)) * values).mean(axis=1).__ge__(values.mean()).sum()) / 20001
    assert flips.p_raw == pytest.approx(exact, abs=0.04)
    assert flips.permuted_std == pytest.approx(np.sqrt((values**2).sum()) / 40, rel=0.1)
    boot = inference.bootstrap_interval(df, 1500, 1).first()
    assert boot.bootstrap_mean == pytest.approx(values.mean(), abs=0.03)
    assert boot.bootstrap_std == pytest.approx(values.std() / np.sqrt(40), rel=0.15)


def test_published_holm_values(spark):
    # Published one-sided p values of the twelve cells that are below 1, and their corrected values.
    raw = [1.0, 0.9658034196580342, 9.999000099990002e-05]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(raw)], "i int, p_raw double")
    got = {r.i: r.p_holm for r in ranks.holm(df, parts=3).collect()}
    assert got[2] == pytest.approx(3 * raw[2]) and got[0] == 1.0 and got[1] == 1.0


def test_holm_against_loop(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(0, 0.2, 30), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p_raw double")
    got = {r.i: r.p_holm for r in ranks.holm(df, parts=3).collect()}
    worst = 0.0
    for rank, i in enumerate(np.argsort(p, kind="stable")):
        worst = max(worst, p[i] * (30 - rank))
        assert got[int(i)] == pytest.approx(min(1.0, worst))


def test_representatives_break_ties(spark):
    semantic = {0: (0.2, 0.3, 0.8, 0.8), 1: (0.4, 0.4, 0.4, 0.4)}
    auditory = {0: (0.5, 0.7, 0.2, 0.1), 1: (0.7, 0.6, 0.3, 0.2)}
    rows = []
    for s, base in (("S01", 0.31), ("S02", 0.47)):
        for family, table, roi in (("SEMANTIC", semantic, "L_AG"), ("AUDITORY", auditory, "L_pSTG")):
            for block, deltas in table.items():
                for state, d in zip(("ATTN", "POST_ATTN", "FFN", "OUTPUT"), deltas):
                    rows.append((s, "EN", "xlmr", block, float(block), state, "SHARED", roi, family, base + d / 2))
                    rows.append((s, "EN", "xlmr", block, float(block), state, "SPECIFIC", roi, family, base - d / 2))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=COLUMNS))
    got = {r.roi_family: (r.block, r.state, round(r.delta_z_mean, 9)) for r in effects.select_representatives(df).collect()}
    assert got == {"SEMANTIC": (0, "FFN", 0.8), "AUDITORY": (0, "POST_ATTN", 0.7)}
    with pytest.raises(ContractError):
        effects.select_representatives(None, df, require_subject_level=True)


def test_representative_layers(spark):
    values = {
        "SEMANTIC": {0: (0.35, 0.20), 1: (0.85, 0.15)}, "AUDITORY": {0: (0.80, 0.20), 1: (0.45, 0.25)}, "CONTROL": {0: (0.95, 0.10), 1: (0.20, 0.10)},
    }
    rows = [
        (lang, model, layer, float(layer), name, f"L_{family}", family, pair[i])
        for lang in ("en", "fr", "zh") for model in ("xlmr", "nllb_encoder") for family, table in values.items()
        for layer, pair in table.items() for i, name in enumerate(("shared", "specific"))
    ]
    df = spark.createDataFrame(rows, "language string, model string, layer_index int, layer_depth double, condition string, roi_name string, roi_family string, mean_z double")
    got = effects.representative_layers(effects.layer_deltas(effects.normalise_group_source(df)))
    effects.demand_row_count(got, 12, "grid")
    assert {(r.roi_family, r.block) for r in got.collect()} == {("SEMANTIC", 1), ("AUDITORY", 0)}


def test_nan_scores_are_skipped(spark):
    rows = [("S1", "EN", "m", 0, 0.0, "FFN", "SHARED", "r", "SEMANTIC", float("nan"), 0.1), ("S2", "EN", "m", 0, 0.0, "FFN", "SHARED", "r", "SEMANTIC", 0.5, 0.3)]
    df = spark.createDataFrame(rows, "subject_id string, language string, model string, block int, block_depth_norm double, state string, condition string, roi string, roi_family string, z_mean double, r_mean double")
    got = effects.group_results(df).first()
    assert got.mean_z == 0.5 and got.n_subjects == 2 and got.ci_low is None


def test_dense_index_matches_order(spark):
    ids = [5, 70000, 3, 200000, 65536, 131072, 9]
    df = spark.createDataFrame([(i,) for i in ids], "triplet_id bigint")
    got = {r.triplet_id: r.triplet_row_index for r in stats.index_by_id(df, "triplet_id").collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_ranges_are_even_whatever_the_groups_and_values(spark):
    """One group with nearly all rows, many of one row, and values that an outlier would push into one equal-width range."""
    rng = np.random.default_rng(4)
    rows = [("giant", float(v)) for v in rng.normal(size=6000)] + [("giant", 1e12)] + [(f"g{i}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    dealt = ranks.in_ranges(df, ["k"], ["v"], parts=8)
    sizes = [r["count"] for r in dealt.groupBy("k", ranks.RANGE).count().collect()]
    assert max(sizes) < 2 * len(rows) / 8 and sum(sizes) == len(rows)
    got = [r for r in ranks.ranked(df, ["k"], ["v"], "place", parts=8).collect() if r.k == "giant"]
    assert [r.place for r in sorted(got, key=lambda r: r.v)] == list(range(6001))
    top = {r.v: r.top for r in ranks.running(dealt, ["k"], ["v"], top=("max", -F.col("v"))).collect() if r.k == "giant"}
    assert set(top.values()) == {-min(top)}


def test_derangements_of_a_giant_run(spark):
    rows = spark.range(2000).selectExpr("'EN' as language", "1 as canonical_run", "id as triplet_row_index").union(spark.range(3).selectExpr("'EN'", "2", "id + 9000"))
    got = features.shuffle_permutations(rows, 2, 1).collect()
    for shuffle in (0, 1):
        one = {r.triplet_row_index: r.permuted_row_index for r in got if r.shuffle_index == shuffle}
        assert sorted(one) == sorted(one.values()) and len(one) == 2003 and all(a != b and (a < 9000) == (b < 9000) for a, b in one.items())


def test_null_correlations_stay_null(spark):
    assert spark.range(1).select(stats.fisher_z(F.lit(None).cast("double")).alias("z")).first().z is None


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], list(np.round(np.random.default_rng(1).normal(size=301), 2)), [0.0] * 50 + [1e9]])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("h", 3.0)], "k string, v double")
    got = {r.k: r for r in ranks.exact_percentiles(df, ["k"], "v", {"low": 0.025, "mid": 0.5, "high": 0.975}, parts=5).collect()}
    assert np.allclose([got["g"].low, got["g"].mid, got["g"].high], np.quantile(values, [0.025, 0.5, 0.975])) and got["h"].mid == 3.0


def test_numbered_digests_equal_md5():
    prefixes = [b"", b"a|", b"1337|m|EN|" + b"x" * 45, b"y" * 64, b"z" * 130]
    for numbers in (range(0, 3), range(0, 12_000), range(95, 1_105), range(99_990, 100_700)):
        got = digests.numbered_md5(prefixes, numbers)
        for i in range(len(prefixes)):
            for j in (0, 1, 2, len(numbers) // 2, len(numbers) - 1):
                assert got[i, j].tobytes() == hashlib.md5(prefixes[i] + b"%d" % numbers[j]).digest()


def test_resampling_makes_no_row_for_a_draw_of_a_subject(spark, monkeypatch):
    """Draws against plain Python, with cells that take several packed pieces and slices; rows of the plans grow with cells and draws only."""
    monkeypatch.setattr(inference, "PIECE", 16)
    monkeypatch.setattr(inference, "SLICE", 64)
    rng = np.random.default_rng(3)
    sizes = {"EN": 150, "FR": 64, "ZH": 1}
    rows = [("m", lang, "h", f"S{i}", float(v)) for lang, n in sizes.items() for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "model string, language string, hypothesis string, subject_id string, effect_value double")
    flips = {(r.language, r.draw): r.permuted_mean for r in inference.sign_flip_draws(df, 70, 9).collect()}
    boots = {(r.language, r.draw): r.sample_mean for r in inference.bootstrap_draws(df, 300, 9).collect()}
    assert len(flips) == 3 * 70 and len(boots) == 3 * 300
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    for lang, n in sizes.items():
        people = [(r[3], r[4]) for r in rows if r[1] == lang]
        for draw in (0, 31, 32, 69):
            signs = [1 if md5(9, "m", lang, "h", "perm", s, draw // 32)[draw % 32] >= "8" else -1 for s, _ in people]
            assert flips[lang, draw] == pytest.approx(np.mean([a * v for a, (_, v) in zip(signs, people)]))
        slots = [v for _, _, v in sorted((md5(s)[:2], s, v) for s, v in people)]
        for draw in (0, 255, 256, 299):
            picks = [int(md5(9, "m", lang, "h", "boot", draw, j // 4)[j % 4 * 8 : j % 4 * 8 + 8], 16) % n for j in range(n)]
            assert boots[lang, draw] == pytest.approx(np.mean([slots[i] for i in picks]))
    plan = inference.sign_flip_draws(df, 70, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.split("MapInArrow")[1]
