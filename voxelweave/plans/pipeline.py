"""Whole stages, composed from the operators: sweep, word attribution, deletion validation.

Each stage is one job over all settings and subjects. Tables that several consumers read (design rows,
moments, fold models, series) are cut, which also bounds what has to be recomputed when executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxelweave.operators import attribution, deletion, design, effects, packed, ridge, upserts
from voxelweave.operators.features import Encoder
from voxelweave.session import cut


def run_sweep(
    rows: DataFrame, targets: DataFrame, target_metadata: DataFrame, setting: Sequence[str], *,
    alphas: Sequence[float] | None = None, max_pcs: int = 128, variance_threshold: float = 0.95, chunk: int = 512, seed: int = 1337,
) -> DataFrame:
    """Subject results of every setting from model rows (x, z per scan) and stacked targets.

    ``setting`` holds the columns that identify a design matrix and has to include ``language``.
    """
    rows = cut(rows)
    gram = cut(ridge.gram_blocks(rows, setting))
    cross = ridge.cross_blocks(rows, targets, setting)
    scores = ridge.fold_scores(gram, cross, setting, alphas=alphas, max_pcs=max_pcs, variance_threshold=variance_threshold, chunk=chunk)
    folds = ridge.choose_alpha(scores, setting, alphas)
    summary = ridge.summarise_folds(folds, [*setting, "target_index"])
    return summary.join(target_metadata, ["language", "target_index"]).drop("target_index").withColumn("seed", F.lit(seed).cast("bigint"))


def group_table(subject_results: DataFrame) -> DataFrame:
    return effects.group_results(subject_results)


def fit_folds(
    rows: DataFrame, targets: DataFrame, setting: Sequence[str], *, alphas: Sequence[float] | None = None,
    max_pcs: int = 128, variance_threshold: float = 0.95, chunk: int = 512,
) -> DataFrame:
    """Fold models (w, u, b, c) of every target at the alpha its inner folds chose."""
    rows = cut(rows)
    gram = cut(ridge.gram_blocks(rows, setting))
    cross = cut(ridge.cross_blocks(rows, targets, setting))
    options = {"max_pcs": max_pcs, "variance_threshold": variance_threshold, "chunk": chunk}
    chosen = ridge.choose_alpha(ridge.fold_scores(gram, cross, setting, alphas=alphas, **options), setting, alphas)
    return cut(ridge.fold_models(gram, cross, chosen.select(*setting, "outer_run", "target_index", "alpha"), setting, **options))


def compute_word_attributions(
    words: DataFrame, states: DataFrame, encoder: Encoder, *, models: DataFrame, series: DataFrame, windows: DataFrame, basis: DataFrame,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Attribution of every candidate word for all settings and subjects.

    ``words``: (model, language = target, block, state, canonical_run, triplet_row_index, sentence_language, word columns..).
    ``texts``: (sentence_language, triplet_row_index, text); without it, ``words`` has the text in every row. The sentence, not
    the setting, decides a mutated text, so it is encoded once for each sentence and span. An encoder that knows ``deletions`` scores
    sentence by sentence (``packed_attributions``); the rows are the same.
    """
    if hasattr(encoder, "deletions"):
        return packed.word_rows(
            packed_attributions(words, states, encoder, models=models, series=series, windows=windows, basis=basis, texts=texts)
        )
    if texts is None:
        texts = words.select("sentence_language", "triplet_row_index", "text").distinct()
    changes = attribution.word_changes(words.drop("text"), texts, states, encoder)
    moments = attribution.window_moments(series, windows, basis)
    return attribution.score_words(changes, models, moments)


def packed_attributions(
    words: DataFrame, states: DataFrame, encoder: Encoder, *, models: DataFrame, series: DataFrame, windows: DataFrame, basis: DataFrame,
    texts: DataFrame | None = None, readers: Column | None = None,
) -> DataFrame:
    """``compute_word_attributions`` with one row per setting and sentence (``packed.score_sentences``)."""
    if texts is None:
        texts = words.select("sentence_language", "triplet_row_index", "text").distinct()
    moments = attribution.window_moments(series, windows, basis)
    return packed.score_sentences(words.drop("text"), texts, states, encoder, models, moments, readers)


def run_deletion_validation(
    attributions: DataFrame, *, models: DataFrame, series: DataFrame, basis: DataFrame, texts: DataFrame, states: DataFrame,
    encoder: Encoder, ks: Sequence[int] = (1, 2), draws: int = 100, seed: int = 1337, adaptive_k3: bool = False,
    min_gain: float = 0.0, finished: DataFrame | None = None,
) -> DataFrame:
    """Deletion rows of all subjects; finished (subject, k) rows are kept and not computed again. Where ``finished`` has
    several rows of a (subject, k), with a column ``written_utc``, the last one wins.

    k = 3 runs only for subjects whose k = 2 gained over k = 1 (when adaptive), inside the same job. ``attributions`` are rows of words or
    packed sentences; packed ones are stored only where a third round reads them again.
    """
    inputs = {
        "models": models, "series": series, "basis": basis, "texts": texts, "states": states, "encoder": encoder, "draws": draws, "seed": seed,
    }
    key = [*deletion.SUBJECT, "k"]
    first = [k for k in sorted(ks) if k != 3 or not adaptive_k3]
    todo = None
    if not packed.is_packed(attributions):
        attributions = cut(attributions)
        todo = attributions.select(*deletion.SUBJECT).distinct()
    elif finished is not None or (adaptive_k3 and 3 in ks):
        attributions = cut(attributions)
        todo = attributions.select(*attribution.SETTING, F.inline("people")).select(*deletion.SUBJECT).distinct()
    if todo is not None:
        todo = todo.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in first])))
    if finished is not None:
        if "written_utc" in finished.columns:
            finished = deletion.last_rows(finished, "written_utc").drop("written_utc")
        done = finished.withColumnsRenamed({"representative_block": "block", "representative_state": "state"})
        todo = upserts.pending(todo, done, key)
        rows = finished.unionByName(deletion.deletion_rows(attributions, ks=first, pending=todo, **inputs))
    else:
        rows = deletion.deletion_rows(attributions, ks=first, pending=todo, **inputs)
    if adaptive_k3 and 3 in ks:
        rows = cut(rows)
        third = deletion.subject_grid(deletion.adaptive_subjects(rows, min_gain), 3)
        if finished is not None:
            third = upserts.pending(third, done, key)
        rows = rows.unionByName(deletion.deletion_rows(attributions, ks=[3], pending=third, **inputs))
    return rows
