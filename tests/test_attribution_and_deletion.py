import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import attribution, deletion, design, features
from voxelweave.plans import pipeline

SETTING = {"model": "m", "language": "EN", "block": 0, "state": "OUTPUT"}
FOLD_SCHEMA = "model string, language string, block int, state string, roi_family string, subject_id string, canonical_run int"


def pearson(a, p):
    a, p = a - a.mean(), p - p.mean()
    d = np.sqrt((a * a).sum() * (p * p).sum())
    return float(np.clip((a * p).sum() / d, -0.999999, 0.999999)) if d > 0 else 0.0


class World:
    """Two runs, four sentences, two source languages, two subjects; everything small enough to redo in NumPy."""

    n, d = 20, 8

    def __init__(self, spark):
        rng = np.random.default_rng(5)
        self.spark = spark
        self.clock = design.ScanClock(2.0, 2.0, (0.2, 0.5, 0.3, -0.1))
        self.texts = {
            (t, lang): text for t, (fr, zh) in enumerate([("le chat dort, ici", "甲乙丙"), ("un et deux", "丁 戊"), ("mer", "己，庚"), ("la vie. la", "辛壬")])
            for lang, text in (("FR", fr), ("ZH", zh))
        }
        self.run = {0: 1, 1: 1, 2: 2, 3: 2}
        self.onset = {0: 0.0, 1: 9.0, 2: 3.0, 3: 15.0}
        self.w = {(s, r): rng.normal(size=self.d) for s in ("S1", "S2") for r in (1, 2)}
        self.actual = {(s, r): rng.normal(size=self.n) for s in ("S1", "S2") for r in (1, 2)}
        self.predicted = {(s, r): rng.normal(size=self.n) for s in ("S1", "S2") for r in (1, 2)}
        timing = spark.createDataFrame([("EN", self.run[t], t, o, o + 4.0) for t, o in self.onset.items()], "language string, canonical_run int, triplet_row_index bigint, onset_sec double, offset_sec double")
        scans = spark.createDataFrame([("EN", r, self.n) for r in (1, 2)], "language string, canonical_run int, n_scans int")
        self.basis = design.sentence_basis(timing, scans, self.clock).cache()
        self.windows = design.response_window(timing, scans, self.clock).cache()
        self.encoder = features.digest_encoder(self.d)
        self.text_df = spark.createDataFrame([(t, lang, x) for (t, lang), x in self.texts.items()], "triplet_row_index bigint, sentence_language string, text string").cache()
        self.states = self.encoder(self.text_df.withColumnRenamed("sentence_language", "language")).drop("text").cache()
        fold = [(*SETTING.values(), "SEMANTIC", s, r) for s, r in self.w]
        self.models = spark.createDataFrame([(*f, [float(v) for v in self.w[f[5], f[6]]]) for f in fold], FOLD_SCHEMA + ", w array<double>").cache()
        self.series = spark.createDataFrame(
            [(*f, i, float(self.actual[f[5], f[6]][i]), float(self.predicted[f[5], f[6]][i])) for f in fold for i in range(self.n)],
            FOLD_SCHEMA + ", scan int, actual double, predicted double",
        ).cache()
        self.weights = np.zeros((4, self.n))
        for r in self.basis.collect():
            self.weights[r.triplet_row_index, r.scan] = r.weight

    def encode(self, texts):
        df = self.spark.createDataFrame([(t, lang) for t, lang in texts], "text string, language string")
        return {(r.text, r.language): np.array(r.vec) for r in self.encoder(df).collect()}

    def words(self):
        from voxelweave.operators.words import segment_words

        keys = ["triplet_row_index", "sentence_language"]
        rows = segment_words(self.text_df, keys, language="sentence_language").join(self.text_df, keys)
        runs = F.create_map(*[F.lit(x) for kv in self.run.items() for x in kv])
        return rows.select(
            *[F.lit(v).alias(k) for k, v in SETTING.items()], runs[F.col("triplet_row_index").cast("int")].alias("canonical_run"), *keys,
            "word_index", "word_text", "word_char_start", "word_char_end", "token_class", "text",
        )


@pytest.fixture(scope="module")
def world(spark):
    return World(spark)


def attributions(world):
    return pipeline.compute_word_attributions(
        world.words(), world.states, world.encoder, models=world.models, series=world.series, windows=world.windows, basis=world.basis
    )


def test_scores_equal_full_recomputation(world):
    rows = attributions(world).toPandas()
    words = world.words().toPandas()
    assert len(rows) == 2 * len(words)
    mutated = {}
    for w in words.itertuples():
        text = w.text[: w.word_char_start] + w.text[w.word_char_end :]
        mutated[w.triplet_row_index, w.sentence_language, w.word_index] = " ".join(text.split()) if w.sentence_language == "FR" else text
    vectors = world.encode({(t, k[1]) for k, t in mutated.items()} | {(x, lang) for (_, lang), x in world.texts.items()})
    windows = {t: [i for i in range(world.n) if o + 2 <= 2 * i < o + 4 + 12] for t, o in world.onset.items()}
    for r in rows.itertuples():
        t, fold = r.triplet_row_index, (r.subject_id, r.canonical_run)
        other = "ZH" if r.sentence_language == "FR" else "FR"
        old = (vectors[world.texts[t, "FR"], "FR"] + vectors[world.texts[t, "ZH"], "ZH"]) / 2
        new = (vectors[mutated[t, r.sentence_language, r.word_index], r.sentence_language] + vectors[world.texts[t, other], other]) / 2
        base = world.predicted[fold]
        moved = base + world.weights[t] * ((new - old) @ world.w[fold])
        a, win = world.actual[fold], windows[t]
        want = np.mean((a[win] - moved[win]) ** 2 - (a[win] - base[win]) ** 2)
        assert r.attribution_score == pytest.approx(want, abs=1e-10)


def test_linear_update_example():
    x = np.array([[0.2, 1], [0.4, 0.8], [0.7, 0.6], [1, 0.2]])
    y = np.array([0.3, 0.5, 0.9, 1.1])
    mu, sd = x.mean(0), x.std(0)
    _, _, vt = np.linalg.svd((x - mu) / sd, full_matrices=False)
    pc = (x - mu) / sd @ vt.T
    w = (vt.T @ np.linalg.solve(pc.T @ pc + 10 * np.eye(2), pc.T @ y)) / sd
    background, basis, old, new = np.array([[0.1, 0.3], [0.2, 0.1]]), np.array([[1.0], [0.5]]), np.array([0.4, 0.8]), np.array([0.9, 0.3])
    full = lambda v: (background + basis * v - mu) @ w
    assert np.allclose(full(new), full(old) + basis[:, 0] * ((new - old) @ w), atol=1e-5)


def test_token_scope(spark):
    reps = spark.createDataFrame([("m", lang, f, 0, "FFN") for lang in ("EN", "FR", "ZH") for f in ("SEMANTIC", "AUDITORY", "CONTROL")], "model string, language string, roi_family string, block int, state string")
    effects = spark.createDataFrame(
        [("m", "EN", "H2_auditory_attention_preference", 0.01, 0.2), ("m", "FR", "H2_auditory_attention_preference", 0.2, 0.2), ("m", "EN", "H1_semantic_ffn_preference", 0.9, -1.0)],
        "model string, language string, hypothesis string, p_holm double, effect_mean double",
    )
    got = {(r.language, r.roi_family): (r.kept, r.scope_reason) for r in attribution.token_scope(reps, effects).collect()}
    assert got["EN", "AUDITORY"] == (True, "auditory_primary_supported") and got["FR", "AUDITORY"] == (False, "auditory_primary_not_significant")
    assert got["ZH", "AUDITORY"] == (False, "auditory_primary_cell_missing") and not got["EN", "CONTROL"][0] and got["ZH", "SEMANTIC"][0]
    none = attribution.token_scope(reps, None)
    assert {r.scope_reason for r in none.where("roi_family = 'AUDITORY'").collect()} == {"primary_effect_tables_missing"}


def candidate_table(spark, spec):
    """spec: list of sentences, each a list of (language, class) ordered by score."""
    rows = [
        (*SETTING.values(), "SEMANTIC", "S1", t, 1, lang, i, 2 * i, 2 * i + 1, kind, 1.0 - 0.01 * i)
        for t, words in enumerate(spec) for i, (lang, kind) in enumerate(words)
    ]
    return spark.createDataFrame(
        rows, "model string, language string, block int, state string, roi_family string, subject_id string, triplet_row_index bigint, canonical_run int, "
        "sentence_language string, word_index int, word_char_start int, word_char_end int, token_class string, attribution_score double",
    )


def test_policies_and_samples(spark):
    spec = [
        [("FR", "CONTENT"), ("FR", "CONTENT"), ("FR", "CONTENT"), ("ZH", "EDGE")],
        [("FR", "CONTENT"), ("FR", "EDGE"), ("FR", "PUNCT"), ("ZH", "EDGE")],
        [("FR", "CONTENT"), ("FR", "PUNCT")],
        [("FR", "CONTENT"), ("ZH", "CONTENT"), ("ZH", "CONTENT")],
    ]
    plan = deletion.matching_plan(deletion.rank_words(candidate_table(spark, spec)), [1])
    policy = {r.triplet_row_index: r.policy for r in plan.select("triplet_row_index", "policy").distinct().collect()}
    assert policy == {0: deletion.EXACT, 1: deletion.LANGUAGE_APART, 2: deletion.LANGUAGE_APART, 3: deletion.LANGUAGE_ANY}
    picks = deletion.sample_words(plan, 40, 3).toPandas()
    chosen = {t: set(zip(g.sentence_language, g.word_index)) for t, g in picks.groupby("triplet_row_index")}
    # Exact: the two other content words. Language: the spoken one only, else the punctuation. Overlap: itself.
    assert chosen == {0: {("FR", 1), ("FR", 2)}, 1: {("FR", 1)}, 2: {("FR", 1)}, 3: {("FR", 0)}}
    assert (picks.groupby(["triplet_row_index", "draw"]).size() == 1).all()


def test_samples_without_replacement_match_the_cells(spark):
    rng = np.random.default_rng(0)
    kinds = ["CONTENT", "FUNCTION", "PUNCT", "EDGE"]
    spec = [[(str(rng.choice(["FR", "ZH"])), str(rng.choice(kinds))) for _ in range(25)] for _ in range(12)]
    ranked = deletion.rank_words(candidate_table(spark, spec)).cache()
    plan = deletion.matching_plan(ranked, [1, 2, 5])
    picks = deletion.sample_words(plan, 6, 9).toPandas()
    assert not picks.duplicated(["triplet_row_index", "k", "draw", "sentence_language", "word_index"]).any()
    for (t, k), group in picks.groupby(["triplet_row_index", "k"]):
        top, rest = spec[t][:k], spec[t][k:]
        exact = all(rest.count(c) >= top.count(c) for c in set(top))
        langs, pool = [x for x, _ in top], [x for x, _ in rest]
        apart = all(pool.count(x) >= langs.count(x) for x in set(langs))
        want = deletion.EXACT if exact else deletion.LANGUAGE_APART if apart else deletion.LANGUAGE_ANY
        assert set(group.policy) == {want}
        for _, draw in group.groupby("draw"):
            have = list(zip(draw.sentence_language, draw.token_class))
            assert sorted(have) == sorted(top) if exact else sorted(x for x, _ in have) == sorted(langs)
            if want != deletion.LANGUAGE_ANY:
                assert (draw.word_index >= k).all()
    assert picks.groupby("draw").word_index.apply(tuple).nunique() > 1


def test_draws_are_sets_of_free_positions(spark):
    """Every draw of a cell against a plain list of the positions that are left, and all words equally often."""
    spec = [[("FR", "CONTENT")] * 23, [("FR", "CONTENT")] * 6]
    plan = deletion.matching_plan(deletion.rank_words(candidate_table(spark, spec)), [3]).cache()
    picks = deletion.sample_words(plan, 400, 5).toPandas()
    keys = plan.select(*deletion.GROUP).distinct().toPandas().set_index("triplet_row_index", drop=False)
    for t, words in enumerate([range(3, 23), range(3, 6)]):
        for draw, group in picks[picks.triplet_row_index == t].groupby("draw"):
            left, want = list(words), []
            for i in range(3):
                text = "|".join(map(str, [5, *keys.loc[t, deletion.GROUP], 3, draw, "FR|CONTENT", i]))
                want.append(left.pop(int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(left)))
            assert sorted(group.word_index) == sorted(want)
    often = picks[picks.triplet_row_index == 0].word_index.value_counts()
    assert len(often) == 20 and often.min() > 30 and often.max() < 95  # 60 expected
    assert picks.groupby(["triplet_row_index", "draw"]).size().eq(3).all()


def test_total_count_fallbacks(spark):
    spec = [[("FR", "CONTENT")] * 4, [("FR", "CONTENT"), ("FR", "EDGE"), ("FR", "PUNCT"), ("FR", "PUNCT")], [("FR", "CONTENT"), ("FR", "CONTENT"), ("ZH", "EDGE")], [("FR", "EDGE")]]
    plan = deletion.total_count_plan(deletion.rank_words(candidate_table(spark, spec)), 2)
    policy = {r.triplet_row_index: r.policy for r in plan.select("triplet_row_index", "policy").distinct().collect()}
    assert policy == {0: deletion.TOTAL_APART, 1: deletion.TOTAL_APART, 2: deletion.TOTAL_ANY, 3: deletion.TOTAL_ANY}
    picks = deletion.sample_words(plan, 5, 1).toPandas()
    assert {t: len(g) // 5 for t, g in picks.groupby("triplet_row_index")} == {0: 2, 1: 2, 2: 2, 3: 1}
    assert (picks[picks.triplet_row_index == 0].word_index >= 2).all()


def brute_scores(world, picks):
    """Mean Fisher z per (subject, k, draw) by rebuilding texts, vectors and predictions."""
    out = {}
    texts = {}
    for key, g in picks.groupby(["subject_id", "k", "draw", "triplet_row_index", "sentence_language"]):
        text = world.texts[key[3], key[4]]
        for s, e in sorted(zip(g.word_char_start, g.word_char_end), reverse=True):
            text = text[:s] + text[e:]
            if key[4] == "FR":
                text = " ".join(text.split())
        texts[key] = text
    vectors = world.encode({(t, k[4]) for k, t in texts.items()} | {(x, lang) for (_, lang), x in world.texts.items()})
    for subject, k, draw in {key[:3] for key in texts}:
        zs = []
        for run in (1, 2):
            moved = world.predicted[subject, run].copy()
            for t, lang in itertools.product([t for t in world.run if world.run[t] == run], ("FR", "ZH")):
                if (subject, k, draw, t, lang) in texts:
                    change = vectors[texts[subject, k, draw, t, lang], lang] - vectors[world.texts[t, lang], lang]
                    moved += world.weights[t] * (change / 2 @ world.w[subject, run])
            zs.append(np.arctanh(pearson(world.actual[subject, run], moved)))
        out[subject, k, draw] = np.mean(zs)
    return out


def test_deletion_rows_equal_brute_force(world):
    rows = attributions(world).cache()
    inputs = dict(models=world.models, series=world.series, basis=world.basis, texts=world.text_df, states=world.states, encoder=world.encoder, draws=3, seed=11)
    got = pipeline.run_deletion_validation(rows, ks=(1, 2), **inputs).toPandas().set_index(["subject_id", "k"])
    plan = deletion.matching_plan(deletion.rank_words(rows), [1, 2])
    top = plan.where("selected").withColumn("draw", F.lit(-1)).toPandas()
    picks = pd.concat([top, deletion.sample_words(plan, 3, 11).toPandas()])
    scores = brute_scores(world, picks)
    for (subject, k), row in got.iterrows():
        base = np.mean([np.arctanh(pearson(world.actual[subject, r], world.predicted[subject, r])) for r in (1, 2)])
        random = np.mean([scores[subject, k, d] for d in range(3)])
        assert row.base_z == pytest.approx(base) and row.topk_z == pytest.approx(scores[subject, k, -1])
        assert row.random_z_mean == pytest.approx(random) and row.delta_diff == pytest.approx((base - scores[subject, k, -1]) - (base - random))
        assert row.n_random_draws == 3 and row.matching_policy
    # A finished row is kept as it is and only the rest is computed.
    first = pipeline.run_deletion_validation(rows, ks=(1,), **inputs).withColumn("base_z", F.lit(-9.0))
    resumed = pipeline.run_deletion_validation(rows, ks=(1, 2), finished=first, **inputs).toPandas().set_index(["subject_id", "k"])
    assert len(resumed) == 4
    for (subject, k), row in resumed.iterrows():
        assert row.base_z == (-9.0 if k == 1 else pytest.approx(got.loc[(subject, k)].base_z))
        assert row.delta_diff == pytest.approx(got.loc[(subject, k)].delta_diff)


def test_third_round_needs_a_gain(spark):
    rows = spark.createDataFrame(
        [("flat", 1, 0.12), ("flat", 2, 0.12), ("up", 1, 0.05), ("up", 2, 0.11), ("only_two", 2, 0.01), ("only_one", 1, 0.5)], "subject_id string, k int, delta_diff double"
    ).select("*", *[F.lit(v).alias(c) for c, v in (("model", "m"), ("language", "EN"), ("roi_family", "SEMANTIC"), ("representative_block", 0), ("representative_state", "FFN"))])
    assert {r.subject_id for r in deletion.adaptive_subjects(rows).collect()} == {"up", "only_two"}


def test_adaptive_round_adds_rows(world):
    rows = attributions(world)
    inputs = dict(models=world.models, series=world.series, basis=world.basis, texts=world.text_df, states=world.states, encoder=world.encoder, draws=2, seed=1)
    got = pipeline.run_deletion_validation(rows, ks=(1, 2, 3), adaptive_k3=True, **inputs).toPandas()
    gain = got.pivot(index="subject_id", columns="k", values="delta_diff")
    third = set(got[got.k == 3].subject_id)
    assert third == set(gain.index[gain[2] - gain[1] > 0])


def test_series_and_models_of_one_descent(world):
    """Fitted models carry their own series, so gains and series share columns."""
    series = world.models.join(world.series, deletion.FOLD).drop("w")
    rows = pipeline.compute_word_attributions(world.words(), world.states, world.encoder, models=world.models, series=series, windows=world.windows, basis=world.basis)
    inputs = dict(models=world.models, basis=world.basis, texts=world.text_df, states=world.states, encoder=world.encoder, draws=2, seed=1)
    got = pipeline.run_deletion_validation(rows, ks=(1, 2, 3), adaptive_k3=True, series=series, **inputs).toPandas()
    want = pipeline.run_deletion_validation(attributions(world), ks=(1, 2, 3), adaptive_k3=True, series=world.series, **inputs).toPandas()
    keys = ["subject_id", "k"]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True))


def test_words_meet_texts_by_sentence(world):
    """Words without their text, and texts beside them, give the same scores, and no row of a word carries a text through a shuffle."""
    parts = dict(models=world.models, series=world.series, windows=world.windows, basis=world.basis)
    got = pipeline.compute_word_attributions(world.words().drop("text"), world.states, world.encoder, texts=world.text_df, **parts)
    keys = ["subject_id", "triplet_row_index", "sentence_language", "word_index"]
    want = attributions(world).toPandas().sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(got.toPandas()[want.columns].sort_values(keys, ignore_index=True), want)
    changes = attribution.word_changes(world.words().drop("text"), world.text_df, world.states, world.encoder)
    assert "mutated_text" not in changes._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_the_plan_equal_its_words(spark):
    rng = np.random.default_rng(2)
    kinds = ["CONTENT", "FUNCTION", "PUNCT", "EDGE"]
    spec = [[(str(rng.choice(["FR", "ZH"])), str(rng.choice(kinds))) for _ in range(rng.integers(1, 9))] for _ in range(60)]
    ranked = deletion.rank_words(candidate_table(spark, spec)).cache()
    keys = ["triplet_row_index", "k", "policy", "cell", "need", "eligible", "selected"]
    words = deletion.matching_plan(ranked, [1, 2, 4]).groupBy(*keys).agg(F.count("*").alias("n_words")).toPandas()
    counts = deletion.matching_counts(ranked, [1, 2, 4]).groupBy(*keys).agg(F.sum("n_words").alias("n_words")).toPandas()
    assert sorted(map(tuple, words.values.tolist())) == sorted(map(tuple, counts.values.tolist())) and words.policy.nunique() == 3
    assert set(deletion.policy_counts(deletion.matching_plan(ranked, [1, 2])).collect()) == set(deletion.policy_counts(deletion.matching_counts(ranked, [1, 2])).collect())


def test_packed_draws_equal_sampled_words(spark):
    kinds = ["CONTENT", "CONTENT", "PUNCT", "FUNCTION", "CONTENT", "CONTENT", "CONTENT"]
    spec = [[("FR" if i % 3 else "ZH", kind) for i, kind in enumerate(kinds)]]
    ranked = deletion.rank_words(candidate_table(spark, spec))
    for ks in ([1], [2], [5]):  # all but the last leave enough words of each class
        wanted = ranked.select(*deletion.SUBJECT, F.lit(ks[0]).alias("k")).distinct()
        row = deletion.sentence_draws(deletion.ranked_sentences(ranked, wanted), 30, 7).collect()[0]
        got = set()
        for person in row.people:
            got |= {
                (person.subject_id, d, row.requests[i].sentence_language, s.start)
                for d, i in zip(person.draws, person["at"]) for s in row.requests[i].spans if d >= 0
            }
        picks = deletion.sample_words(deletion.matching_plan(ranked, ks), 30, 7).collect()
        assert got == {(r.subject_id, r.draw, r.sentence_language, r.word_char_start) for r in picks}
        assert len({(r.sentence_language, str(r.spans)) for r in row.requests}) == len(row.requests)  # each text is asked for once


def test_window_moments_shuffle_no_row_for_a_scan_and_fold(spark):
    """Folds without some scans or with missing errors, a sentence beyond the basis, crowded runs; and the plan has no row-wise join of scans with folds."""
    rng = np.random.default_rng(3)
    windows = [("EN", r, s, t) for t in range(40) for r in (1, 2) if t % 2 == r - 1 for s in range(t % 7, t % 7 + 5)]
    basis = [("EN", r, s, t, float(rng.normal())) for _, r, s, t in windows if s % 3 and t != 5]
    series = [("m", "EN", 0, "OUTPUT", "SEMANTIC", u, r, s, None if (u, s) == ("b", 4) else float(rng.normal()), float(rng.normal()))
              for u in "abc" for r in (1, 2) for s in range(12) if (u, s) != ("c", 3)]
    weight = {(t, s): w for _, _, s, t, w in basis}
    want = {}
    for _, r, s, t in windows:
        for *_, u, run, scan, actual, predicted in series:
            if (run, scan) == (r, s):
                w = weight.get((t, s), 0.0)
                want.setdefault((u, t), []).append((w * w, None if actual is None else w * (actual - predicted)))
    frames = [
        spark.createDataFrame(series, FOLD_SCHEMA + ", scan int, actual double, predicted double"),
        spark.createDataFrame(windows, "language string, canonical_run int, scan int, triplet_row_index bigint"),
        spark.createDataFrame(basis, "language string, canonical_run int, scan int, triplet_row_index bigint, weight double"),
    ]
    found = attribution.window_moments(*frames, hot=7)
    got = {(r.subject_id, r.triplet_row_index): (r.weight_sq, r.weight_error) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, pairs in want.items():
        errors = [e for _, e in pairs if e is not None]
        assert got[k] == pytest.approx((np.mean([q for q, _ in pairs]), np.mean(errors)), abs=1e-12)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
