"""Moments against an independent row-level solve written for the tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import ridge
from voxelweave.plans import pipeline

ALPHAS = 10.0 ** np.linspace(-2, 6, 15)


def one_split(train, test, x, y, z, alphas, max_pcs, threshold):
    """Predictions of every alpha on the test rows, and the test targets, row by row."""
    bx, by = np.linalg.pinv(z[train]) @ x[train], np.linalg.pinv(z[train]) @ y[train]
    xr, yr = x - z @ bx, y - z @ by
    mu, sd = xr[train].mean(0), xr[train].std(0)
    sd[sd < 1e-6] = 1.0
    xs = (xr - mu) / sd
    _, s, vt = np.linalg.svd(xs[train], full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), threshold)) + 1
    k = min(k, max_pcs, train.sum() - 1, x.shape[1])
    pc = xs @ vt[:k].T
    gram, xy = pc[train].T @ pc[train], pc[train].T @ yr[train]
    preds = [pc[test] @ np.linalg.solve(gram + a * np.eye(k), xy) for a in alphas]
    return np.stack(preds), yr[test], k


def correlation(p, y):
    p, y = p - p.mean(0), y - y.mean(0)
    d = np.sqrt((p * p).sum(0) * (y * y).sum(0))
    return np.clip(np.divide((p * y).sum(0), d, out=np.zeros_like(d), where=d > 0), -0.999999, 0.999999)


def row_level(run, x, y, z, max_pcs, threshold=0.95):
    out = []
    for a in np.unique(run):
        scores = []
        for b in np.unique(run[run != a]):
            p, t, _ = one_split((run != a) & (run != b), run == b, x, y, z, ALPHAS, max_pcs, threshold)
            scores.append([np.arctanh(correlation(p[i], t)) for i in range(15)])
        mean = np.round(np.mean(scores, axis=0), 12)
        best = 14 - np.argmax(mean[::-1], axis=0)
        p, t, k = one_split(run != a, run == a, x, y, z, ALPHAS, max_pcs, threshold)
        for j in range(y.shape[1]):
            pred = p[best[j], :, j]
            out.append((int(a), j, ALPHAS[best[j]], correlation(pred[:, None], t[:, [j]])[0], ((t[:, j] - pred) ** 2).sum(), k))
    return out


def tables(spark, run, x, y, z):
    rows = [
        ("s", "EN", int(r), i, [float(v) for v in x[i]], [float(v) for v in z[i]], [float(v) for v in y[i]]) for i, r in enumerate(run)
    ]
    df = spark.createDataFrame(rows, "setting string, language string, canonical_run int, scan int, x array<double>, z array<double>, y array<double>").cache()
    return df.select("setting", "language", "canonical_run", "scan", "x", "z"), df


def targets_of(df, chunk, width):
    parts = [df.select("language", "canonical_run", "scan", F.lit(c).alias("chunk"), F.slice("y", c * chunk + 1, chunk).alias("y")) for c in range((width + chunk - 1) // chunk)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data(seed=1337, d=8, rare=False):
    rng = np.random.default_rng(seed)
    run = np.repeat(np.arange(1, 5), 30)
    mix = rng.normal(size=(d, d))
    x = rng.normal(size=(120, d)) @ mix
    y = x @ rng.normal(size=(d, 3)) + 0.05 * rng.normal(size=(120, 3))
    z = np.column_stack([np.ones(120), np.tile(np.linspace(-1, 1, 30), 4)])
    if rare:
        # A regressor alive in one run only, a copy of another one, and a constant feature.
        z = np.column_stack([z, np.where(run == 1, rng.normal(size=120), 0.0), z[:, 1]])
        x[:, 2] = 3.0
        y += 5.0
    return run, x, y, z


@pytest.mark.parametrize("rare,max_pcs,chunk", [(False, 6, 2), (True, 6, 3), (False, 3, 1)])
def test_moments_equal_row_level(spark, rare, max_pcs, chunk):
    run, x, y, z = data(rare=rare)
    rows, df = tables(spark, run, x, y, z)
    gram = ridge.gram_blocks(rows, ["setting", "language"], bucket=16).cache()
    cross = ridge.cross_blocks(rows, targets_of(df, chunk, 3), ["setting", "language"], bucket=16).cache()
    scores = ridge.fold_scores(gram, cross, ["setting", "language"], max_pcs=max_pcs, chunk=chunk)
    got = {(r.outer_run, r.target_index): r for r in ridge.choose_alpha(scores, ["setting", "language"]).collect()}
    want = row_level(run, x, y, z, max_pcs)
    assert len(got) == len(want) == 12
    for a, j, alpha, r, sse, k in want:
        row = got[a, j]
        assert row.alpha == pytest.approx(alpha) and row.n_pcs == k
        assert row.fold_r == pytest.approx(r, abs=1e-8) and row.sse == pytest.approx(sse, rel=1e-6)


def test_sweep_scores_easy_data(spark):
    run, x, y, z = data()
    rows, df = tables(spark, run, x, y, z)
    meta = spark.createDataFrame([("EN", j, f"S{j}", "roi", "SEMANTIC") for j in range(3)], "language string, target_index bigint, subject_id string, roi string, roi_family string")
    got = pipeline.run_sweep(rows, targets_of(df, 512, 3), meta, ["setting", "language"], max_pcs=6).toPandas()
    assert len(got) == 3 and (got["r_mean"] > 0.5).all() and (got["n_outer_folds"] == 4).all() and (got["n_timepoints_total"] == 120).all()
    assert (got["r2_concat"] > 0.3).all() and got["alpha_best_mode"].isin(np.array(ridge.alpha_grid())).all()


def test_fold_models_predict_the_same(spark):
    run, x, y, z = data(rare=True)
    rows, df = tables(spark, run, x, y, z)
    models = pipeline.fit_folds(rows, targets_of(df, 512, 3), ["setting", "language"], max_pcs=6).collect()
    want = {(a, j): (alpha, sse) for a, j, alpha, _, sse, _ in row_level(run, x, y, z, 6)}
    for m in models:
        alpha, sse = want[m.canonical_run, m.target_index]
        test = run == m.canonical_run
        pred = x[test] @ np.array(m.w) + z[test] @ np.array(m.u) + m.c
        actual = y[test, m.target_index] - z[test] @ np.array(m.b)
        assert m.alpha == pytest.approx(alpha) and ((actual - pred) ** 2).sum() == pytest.approx(sse, rel=1e-6)


def test_larger_alpha_wins_ties(spark):
    rows = [("s", 1, t, 0, [0.3, 0.3, 0.1], [1.0, 2.0, 3.0], 0.0, 1.0, 1.0, 1) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, "setting string, outer_run int, test_run int, target_index bigint, r array<double>, sse array<double>, y_sum double, y_sq double, n double, n_pcs int")
    got = ridge.choose_alpha(df, ["setting"], [0.1, 1.0, 10.0]).first()
    assert got.alpha == 1.0 and got.sse == 2.0
    folds = spark.createDataFrame([("t", a, 0.2, 0.0, 1.0, 1.0, 0.5, 3) for a in (0.1, 0.1, 10.0, 10.0, 1.0)], "t string, alpha double, fold_z double, y_sum double, y_sq double, n double, sse double, n_pcs int")
    assert ridge.summarise_folds(folds, ["t"]).first().alpha_best_mode == 10.0
