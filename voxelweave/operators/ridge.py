"""Nested leave-one-run-out ridge for many targets, from second moments.

Rows w = [1, x, z] of a run enter only through G = sum w w', C = sum w y' and the squares of y. These
blocks add up over runs, so every train set is a sum of blocks and no stacked matrix exists. Moments
are formed per bounded scan bucket and added by Spark; a solve task gets the blocks of one setting, one
held-out run and one chunk of targets (runs x (1 + d + q)^2 numbers, independent of the rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelweave.functions.stats import R_LIMIT, alpha_grid, fisher_z
from voxelweave.functions.vector import vector_sum

SCAN_BUCKET = 2048
MIN_STD = 1.0e-6  # Fixed value: smaller standard deviations scale by 1.
NULL_SPACE = 1.0e-11  # relative eigenvalue of Z'Z below which a direction is dropped


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def model_rows(design: DataFrame, nuisance: DataFrame) -> DataFrame:
    """Design and nuisance of every scan side by side: x, z."""
    return design.join(nuisance, ["language", "canonical_run", "scan"])


def gram_blocks(rows: DataFrame, setting: Sequence[str], bucket: int = SCAN_BUCKET) -> DataFrame:
    """G = sum w w' per setting and run, with the widths d and q."""
    keys = [*setting, "canonical_run"]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x, z = _matrix(pdf["x"]), _matrix(pdf["z"])
        w = np.hstack([np.ones((len(pdf), 1)), x, z])
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "d": [x.shape[1]], "q": [z.shape[1]], "g": [(w.T @ w).ravel()]})

    parts = (
        rows.select(*keys, "x", "z", F.floor(F.col("scan") / F.lit(bucket)).alias("_bucket"))
        .groupBy(*keys, "_bucket")
        .applyInPandas(block, f"{_schema(rows, keys)}, d int, q int, g array<double>")
    )
    return parts.groupBy(*keys).agg(F.max("d").alias("d"), F.max("q").alias("q"), vector_sum(F.col("g")).alias("g"))


def cross_blocks(rows: DataFrame, targets: DataFrame, setting: Sequence[str], bucket: int = SCAN_BUCKET) -> DataFrame:
    """C = sum w y' and sum y^2 per setting, run and chunk of targets."""
    keys = [*setting, "canonical_run", "chunk"]
    joined = rows.join(targets, ["language", "canonical_run", "scan"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _matrix(pdf["y"])
        w = np.hstack([np.ones((len(pdf), 1)), _matrix(pdf["x"]), _matrix(pdf["z"])])
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "c": [(w.T @ y).ravel()], "yy": [(y * y).sum(axis=0)]})

    parts = (
        joined.select(*keys, "x", "z", "y", F.floor(F.col("scan") / F.lit(bucket)).alias("_bucket"))
        .groupBy(*keys, "_bucket")
        .applyInPandas(block, f"{_schema(joined, keys)}, c array<double>, yy array<double>")
    )
    return parts.groupBy(*keys).agg(vector_sum(F.col("c")).alias("c"), vector_sum(F.col("yy")).alias("yy"))


@dataclass
class Moments:
    """Blocks of one or more runs; adding runs adds blocks."""

    g: np.ndarray
    c: np.ndarray
    yy: np.ndarray

    def residual(self, bx: np.ndarray, by: np.ndarray, d: int) -> tuple:
        """n, sum x, x'x, x'y, sum y, diag y'y after removing z bx from x and z by from y."""
        x, z = slice(1, 1 + d), slice(1 + d, None)
        g, c = self.g, self.c
        zz, zx, zy = g[z, z], g[z, x], c[z]
        sx = g[0, x] - g[0, z] @ bx
        sy = c[0] - g[0, z] @ by
        cross = zx.T @ bx
        xx = g[x, x] - cross - cross.T + bx.T @ zz @ bx
        xy = c[x] - zx.T @ by - bx.T @ zy + bx.T @ zz @ by
        yy = self.yy - 2.0 * (by * zy).sum(axis=0) + (by * (zz @ by)).sum(axis=0)
        return g[0, 0], sx, xx, xy, sy, yy


def null_safe_inverse(zz: np.ndarray) -> np.ndarray:
    lam, vec = np.linalg.eigh(zz)
    keep = lam > NULL_SPACE * max(lam.max(), 0.0)
    return (vec[:, keep] / lam[keep]) @ vec[:, keep].T


@dataclass
class Fit:
    """Everything learned from one train set: nuisance maps, scaling, components, component cross-moments."""

    bx: np.ndarray
    by: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray
    lam: np.ndarray
    target: np.ndarray

    def coefficients(self, alpha: float | np.ndarray) -> np.ndarray:
        return self.target / (self.lam[:, None] + alpha)


def fit(train: Moments, d: int, max_pcs: int, variance_threshold: float) -> Fit:
    z = slice(1 + d, None)
    inverse = null_safe_inverse(train.g[z, z])
    bx, by = inverse @ train.g[z, 1 : 1 + d], inverse @ train.c[z]
    n, sx, xx, xy, sy, _ = train.residual(bx, by, d)
    mean = sx / n
    spread = np.sqrt(np.maximum(np.diag(xx) / n - mean * mean, 0.0))
    std = np.where(spread < MIN_STD, 1.0, spread)
    cov = (xx - n * np.outer(mean, mean)) / np.outer(std, std)
    lam, vec = np.linalg.eigh(cov)
    lam, vec = np.maximum(lam[::-1], 0.0), vec[:, ::-1]
    share = np.cumsum(lam) / max(lam.sum(), 1.0e-12)
    cap = max(1, min(max_pcs, int(n) - 1, d))
    keep = max(1, min(int(np.searchsorted(share, variance_threshold)) + 1, cap))
    components = vec[:, :keep].T
    target = components @ ((xy - np.outer(mean, sy)) / std[:, None])
    return Fit(bx, by, mean, std, components, lam[:keep], target)


def held_out_scores(model: Fit, test: Moments, d: int, alphas: np.ndarray) -> dict[str, np.ndarray]:
    """r and squared error of every (alpha, target) on held-out blocks, with the sums behind R2."""
    n, sx, xx, xy, sy, yy = test.residual(model.bx, model.by, d)
    project = model.components / model.std
    ps = project @ (sx - n * model.mean)
    centred = xx - np.outer(sx, model.mean) - np.outer(model.mean, sx) + n * np.outer(model.mean, model.mean)
    pp = project @ centred @ project.T
    py = project @ (xy - np.outer(model.mean, sy))
    coef = model.target[None] / (model.lam[None, :, None] + alphas[:, None, None])
    sp = np.einsum("k,akm->am", ps, coef)
    spp = np.einsum("akm,akm->am", coef, np.einsum("kj,ajm->akm", pp, coef))
    spy = np.einsum("akm,km->am", coef, py)
    var_y, var_p = yy - sy * sy / n, spp - sp * sp / n
    spread = var_y * var_p
    # Cancellation leaves a tiny positive rest where a side is constant; that counts as no spread.
    solid = (var_y > 1e-12 * np.maximum(yy, 1e-300)) & (var_p > 1e-12 * np.maximum(spp, 1e-300)) & (spread > 0)
    r = np.where(solid, (spy - sp * sy / n) / np.sqrt(np.where(solid, spread, 1.0)), 0.0)
    return {"r": np.clip(r, -R_LIMIT, R_LIMIT), "sse": yy - 2.0 * spy + spp, "sy": sy, "yy": yy, "n": n}


def _blocks(pdf: pd.DataFrame) -> tuple[dict[int, Moments], int]:
    d, q = int(pdf["d"].iloc[0]), int(pdf["q"].iloc[0])
    p = 1 + d + q
    runs = {}
    for run, g, c, yy in zip(pdf["canonical_run"], pdf["g"], pdf["c"], pdf["yy"]):
        yy = np.asarray(yy, dtype=np.float64)
        runs[int(run)] = Moments(np.asarray(g).reshape(p, p), np.asarray(c).reshape(p, yy.size), yy)
    return runs, d


def _train(runs: dict[int, Moments], left_out: set[int]) -> Moments:
    kept = [m for run, m in runs.items() if run not in left_out]
    return Moments(sum(m.g for m in kept), sum(m.c for m in kept), sum(m.yy for m in kept))


def _for_each_outer_run(gram: DataFrame, cross: DataFrame, setting: Sequence[str]) -> DataFrame:
    """Blocks of all runs of a setting, repeated for every run to hold out."""
    outer = gram.select(*setting, F.col("canonical_run").alias("outer_run"))
    return cross.join(gram, [*setting, "canonical_run"]).join(outer, list(setting))


def fold_scores(
    gram: DataFrame, cross: DataFrame, setting: Sequence[str], *, alphas: Sequence[float] | None = None,
    max_pcs: int = 128, variance_threshold: float = 0.95, chunk: int = 512,
) -> DataFrame:
    """Scores of all folds: outer_run held out, test_run scored, arrays over the alpha grid.

    Rows with test_run = outer_run are outer folds; the others are inner folds. Holding out {a, b} is one
    fit for both "a outer, b inner" and the reverse, so each pair is fitted by one of the two tasks.
    """
    grid = np.asarray(alphas if alphas is not None else alpha_grid(), dtype=np.float64)
    keys = list(setting)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, d = _blocks(pdf)
        order = sorted(runs)
        a, base = int(pdf["outer_run"].iloc[0]), int(pdf["chunk"].iloc[0]) * chunk
        head = {k: pdf[k].iloc[0] for k in keys}
        out = []

        def emit(outer: int, test: int, model: Fit) -> None:
            s = held_out_scores(model, runs[test], d, grid)
            for t in range(s["sy"].size):
                out.append(
                    {**head, "outer_run": outer, "test_run": test, "target_index": base + t, "n_pcs": model.lam.size,
                     "r": s["r"][:, t], "sse": s["sse"][:, t], "y_sum": s["sy"][t], "y_sq": s["yy"][t], "n": s["n"]}
                )

        emit(a, a, fit(_train(runs, {a}), d, max_pcs, variance_threshold))
        size, at = len(order), order.index(a)
        for step in range(1, size):
            b = order[(at + step) % size]
            if 2 * step < size or (2 * step == size and a < b):
                model = fit(_train(runs, {a, b}), d, max_pcs, variance_threshold)
                emit(a, b, model)
                emit(b, a, model)
        return pd.DataFrame(out)

    schema = (
        f"{_schema(gram, keys)}, outer_run int, test_run int, target_index bigint, n_pcs int, "
        "r array<double>, sse array<double>, y_sum double, y_sq double, n double"
    )
    return _for_each_outer_run(gram, cross, setting).groupBy(*keys, "outer_run", "chunk").applyInPandas(solve, schema)


def choose_alpha(scores: DataFrame, setting: Sequence[str], alphas: Sequence[float] | None = None, decimals: int = 12) -> DataFrame:
    """Per setting, outer run and target: the alpha with the best mean inner Fisher z (larger alpha on ties),
    with the outer fold's score at that alpha."""
    grid = list(alphas if alphas is not None else alpha_grid())
    keys = [*setting, "outer_run", "target_index"]
    inner, outer = F.col("test_run") != F.col("outer_run"), F.col("test_run") == F.col("outer_run")
    means = [F.avg(F.when(inner, fisher_z(F.col("r")[i]))).alias(f"_m{i}") for i in range(len(grid))]
    picked = scores.groupBy(*keys).agg(
        *means,
        *[F.first(F.when(outer, F.col(c)), ignorenulls=True).alias(c) for c in ("r", "sse", "y_sum", "y_sq", "n", "n_pcs")],
    )
    ranked = [
        F.struct(F.round(F.col(f"_m{i}"), decimals).alias("score"), F.lit(float(a)).alias("alpha"), F.lit(i).alias("i"))
        for i, a in enumerate(grid)
    ]
    return (
        picked.withColumn("_best", F.array_max(F.array(*ranked)))
        .select(
            *keys, F.col("_best.alpha").alias("alpha"), F.col("_best.score").alias("inner_score"),
            F.element_at("r", F.col("_best.i") + 1).alias("fold_r"),
            F.element_at("sse", F.col("_best.i") + 1).alias("sse"),
            "y_sum", "y_sq", "n", "n_pcs",
        )
        .withColumn("fold_z", fisher_z(F.col("fold_r")))
    )


def summarise_folds(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean z, r = tanh(mean z), modal alpha (larger wins ties), mean log10 alpha, mean components, concatenated R2."""
    listed = F.collect_list("alpha")
    total, squares, n, sse = F.sum("y_sum"), F.sum("y_sq"), F.sum("n"), F.sum("sse")
    spread = squares - total * total / n
    rows = folds.groupBy(*keys).agg(
        F.avg("fold_z").alias("z_mean"),
        F.when(spread <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - sse / spread).alias("r2_concat"),
        listed.alias("_alphas"),
        F.avg(F.log10("alpha")).alias("alpha_best_mean_log10"),
        F.avg(F.col("n_pcs").cast("double")).alias("n_pcs_mean"),
        F.count(F.lit(1)).alias("n_outer_folds"),
        n.cast("bigint").alias("n_timepoints_total"),
    )
    votes = F.transform(
        F.array_distinct("_alphas"),
        lambda a: F.struct(F.size(F.filter("_alphas", lambda x: x == a)).alias("votes"), a.alias("alpha")),
    )
    return rows.withColumn("r_mean", F.tanh("z_mean")).withColumn("alpha_best_mode", F.array_max(votes)["alpha"]).drop("_alphas")


def fold_models(
    gram: DataFrame, cross: DataFrame, chosen: DataFrame, setting: Sequence[str], *,
    max_pcs: int = 128, variance_threshold: float = 0.95, chunk: int = 512,
) -> DataFrame:
    """Outer-fold models at their chosen alpha, one row per setting, held-out run and target.

    prediction(scan) = x . w + z . u + c and actual(scan) = y - z . b; a sentence with vector v adds
    weight * (v . w) to the prediction.
    """
    keys = list(setting)
    alphas = chosen.withColumn("chunk", F.floor(F.col("target_index") / F.lit(chunk)).cast("int")).groupBy(*keys, "outer_run", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("target_index", "alpha"))).alias("_a")
    ).withColumn("alphas", F.col("_a.alpha")).drop("_a")
    tasks = _for_each_outer_run(gram, cross, setting).join(alphas, [*keys, "outer_run", "chunk"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, d = _blocks(pdf)
        a, base = int(pdf["outer_run"].iloc[0]), int(pdf["chunk"].iloc[0]) * chunk
        alpha = np.asarray(pdf["alphas"].iloc[0], dtype=np.float64)
        model = fit(_train(runs, {a}), d, max_pcs, variance_threshold)
        w = (model.components.T @ model.coefficients(alpha)) / model.std[:, None]
        u, c = -(model.bx @ w), -(model.mean @ w)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame(
            [{**head, "canonical_run": a, "target_index": base + t, "alpha": alpha[t], "n_pcs": model.lam.size,
              "w": w[:, t], "u": u[:, t], "b": model.by[:, t], "c": c[t]} for t in range(alpha.size)]
        )

    schema = (
        f"{_schema(gram, keys)}, canonical_run int, target_index bigint, alpha double, n_pcs int, "
        "w array<double>, u array<double>, b array<double>, c double"
    )
    return tasks.groupBy(*keys, "outer_run", "chunk").applyInPandas(solve, schema)
