"""Word attribution: error increase in the response window after deleting one word.

Deleting a word changes the prediction of a held-out run by weight(scan) * g with g = delta . w, where
delta is half the change of the mutated source vector. The mean error increase over the window is then
g^2 * mean(weight^2) - 2 g * mean(weight * error), so scans are reduced once per (sentence, fold) and never
multiplied by the candidate words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxelweave.checks import demand_empty
from voxelweave.functions.text import delete_span
from voxelweave.functions.vector import dot, doubles, minus
from voxelweave.operators.features import Encoder
from voxelweave.schemas import H2
from voxelweave.session import spread

SETTING = ["model", "language", "block", "state"]
FOLD = [*SETTING, "roi_family", "subject_id", "canonical_run"]


def token_scope(
    representatives: DataFrame, primary_effects: DataFrame | None, *, include_semantic: bool = True, include_auditory: bool = True,
    p_threshold: float = 0.05, require_positive: bool = True,
) -> DataFrame:
    """Representatives with a scope reason; ``kept`` marks those that get word-level work."""
    auditory = F.col("roi_family") == "AUDITORY"
    semantic = F.col("roi_family") == "SEMANTIC"
    if primary_effects is None:
        joined = representatives.withColumn("p_holm", F.lit(None).cast("double")).withColumn("effect_mean", F.lit(None).cast("double"))
        missing = F.lit("primary_effect_tables_missing")
        joined = joined.withColumn("_cell", F.lit(None).cast("int"))
    else:
        cells = primary_effects.where(F.col("hypothesis") == H2).select("model", "language", "p_holm", "effect_mean", F.lit(1).alias("_cell"))
        joined = representatives.join(cells, ["model", "language"], "left")
        missing = F.lit("auditory_primary_cell_missing")
    weak = F.col("p_holm").isNull() | F.isnan("p_holm") | (F.col("p_holm") >= p_threshold)
    flat = F.lit(require_positive) & (F.col("effect_mean").isNull() | F.isnan("effect_mean") | (F.col("effect_mean") <= 0))
    reason = (
        F.when(semantic, F.lit("semantic" if include_semantic else "semantic_disabled"))
        .when(~auditory, F.lit("family_out_of_scope"))
        .when(F.lit(not include_auditory), F.lit("auditory_token_scope_disabled"))
        .when(F.col("_cell").isNull(), missing)
        .when(weak, F.lit("auditory_primary_not_significant"))
        .when(flat, F.lit("auditory_primary_nonpositive"))
        .otherwise(F.lit("auditory_primary_supported"))
    )
    return (
        joined.withColumn("scope_reason", reason)
        .withColumn("kept", F.col("scope_reason").isin("semantic", "auditory_primary_supported"))
        .drop("_cell", "p_holm", "effect_mean")
    )


def word_changes(words: DataFrame, texts: DataFrame, states: DataFrame, encoder: Encoder) -> DataFrame:
    """Candidate words with ``delta``, half the change of the source vector after deleting the word.

    Only spans are shuffled: they meet the text of their sentence as one row, and the texts without a word are made and encoded
    in place, once for each span of a sentence, whatever number of targets and settings reads it.
    """
    sentence = ["sentence_language", "triplet_row_index"]
    span = ["word_char_start", "word_char_end"]
    spans = spread(words.select(*sentence, *span), *sentence).groupBy(*sentence).agg(F.collect_set(F.struct(*span)).alias("_spans"))
    stored = states.select(F.col("language").alias("sentence_language"), "triplet_row_index", doubles(F.col("vec")).alias("_stored"))
    rows = spans.join(texts.select(*sentence, "text"), sentence).join(stored, sentence)
    rows = rows.select(*sentence, "text", "_stored", F.inline("_spans"))
    mutated = delete_span(F.col("text"), F.col("word_char_start"), F.col("word_char_end"), F.col("sentence_language"))
    encoded = encoder(rows.select(F.col("sentence_language").alias("language"), "triplet_row_index", *span, "_stored", mutated.alias("text")))
    change = F.transform(minus(doubles(F.col("vec")), F.col("_stored")), lambda x: x / F.lit(2.0))
    changes = encoded.select(F.col("language").alias("sentence_language"), "triplet_row_index", *span, change.alias("delta"))
    return words.join(changes, [*sentence, *span])


def vector_changes(requests: DataFrame, states: DataFrame, encoder: Encoder, text: str = "mutated_text") -> DataFrame:
    """Half the change of the source vector for every mutated text; each distinct text is encoded once."""
    texts = requests.select(F.col("sentence_language").alias("language"), F.col(text).alias("text")).distinct()
    texts = spread(texts, "text")
    vectors = encoder(texts).select(F.col("language").alias("sentence_language"), F.col("text").alias(text), "vec")
    encoded = requests.join(vectors, ["sentence_language", text]).drop(text)
    stored = states.select(F.col("language").alias("sentence_language"), "triplet_row_index", doubles(F.col("vec")).alias("_stored"))
    change = F.transform(minus(doubles(F.col("vec")), F.col("_stored")), lambda x: x / F.lit(2.0))
    return encoded.join(stored, ["sentence_language", "triplet_row_index"]).withColumn("delta", change).drop("vec", "_stored")


def fold_series(models: DataFrame, design: DataFrame, nuisance: DataFrame, targets: DataFrame) -> DataFrame:
    """Residual actual and predicted value of every held-out scan.

    ``models`` carries w, u, b, c per fold; ``targets`` is (language, subject_id, roi_family, canonical_run, scan, value).
    """
    setting = [c for c in SETTING if c in design.columns]
    rows = (
        models.join(design, [*setting, "canonical_run"])
        .join(nuisance, ["language", "canonical_run", "scan"])
        .join(targets, ["language", "subject_id", "roi_family", "canonical_run", "scan"])
    )
    return rows.select(
        *FOLD, "scan",
        (F.col("value") - dot(F.col("z"), F.col("b"))).alias("actual"),
        (dot(F.col("x"), F.col("w")) + dot(F.col("z"), F.col("u")) + F.col("c")).alias("predicted"),
    )


def window_moments(series: DataFrame, windows: DataFrame, basis: DataFrame, hot: int = 4096) -> DataFrame:
    """Per (fold, sentence): mean squared weight and mean weight x error over the response window.

    Scans meet folds as matrices, a task for each run and ``hot`` of its sentences: what is shuffled is one row of scans for each sentence
    and one of errors for each fold and task, never a row for each scan and fold of a sentence.
    """
    sentence = ["language", "canonical_run", "triplet_row_index"]
    inside = windows.groupBy(*sentence).agg(F.collect_list("scan").alias("scans"))
    weighted = basis.groupBy(*sentence).agg(F.collect_list(F.struct("scan", "weight")).alias("weights"))
    packed = inside.join(weighted, sentence, "left")
    crowd = packed.groupBy("language", "canonical_run").agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).cast("int").alias("_tasks"))
    error = F.col("actual") - F.col("predicted")
    errors = series.groupBy(*FOLD).agg(F.collect_list(F.struct("scan", error.alias("error"))).alias("errors")).join(crowd, ["language", "canonical_run"])
    # Aliases, since both sides come from the same sentences and a cogroup tells columns apart by their origin.
    left = packed.join(crowd, ["language", "canonical_run"]).select(
        *[F.col(c).alias(c) for c in ("language", "canonical_run")], F.pmod(F.xxhash64("triplet_row_index"), F.col("_tasks")).cast("int").alias("_task"),
        F.col("triplet_row_index").alias("triplet_row_index"), F.col("scans").alias("scans"), F.col("weights").alias("weights"),
    )
    right = errors.select(*[F.col(c).alias(c) for c in (*FOLD, "errors")], F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"))
    kinds = dict(series.dtypes) | dict(windows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*FOLD, "triplet_row_index")) + ", weight_sq double, weight_error double"
    keys = ["language", "canonical_run", "_task"]

    def run(sentences: pa.Table, folds: pa.Table) -> pa.Table:
        none = pa.array([], pa.float64())
        empty = [*(folds[c].slice(0, 0) for c in FOLD), sentences["triplet_row_index"].slice(0, 0), none, none]
        made = [pa.table(empty, names=[*FOLD, "triplet_row_index", "weight_sq", "weight_error"])]
        if not sentences.num_rows or not folds.num_rows:
            return made[0]
        scans, weights = _listed(sentences["scans"]), _listed(sentences["weights"], "scan", "weight")
        errors = _listed(folds["errors"], "scan", "error")
        steps = scans.rename(columns={"value": "scan"}).merge(weights, on=["row", "scan"], how="left").sort_values("row", kind="stable")
        steps["weight"] = steps["weight"].fillna(0.0)
        places, at = np.unique(errors["scan"].to_numpy(), return_inverse=True)
        steps = steps[np.isin(steps["scan"].to_numpy(), places)]
        shape, cell = (len(places), folds.num_rows), (at, errors["row"].to_numpy())
        rows, known, total = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        found = ~errors["missing"].to_numpy()
        np.add.at(rows, cell, 1.0)
        np.add.at(known, cell, found.astype(float))
        np.add.at(total, cell, np.where(found, errors["error"].to_numpy(np.float64), 0.0))
        number = steps["row"].to_numpy()
        for first in range(0, sentences.num_rows, 256):  # bounds the products, however many folds there are
            part = steps[(number >= first) & (number < first + 256)]
            if not len(part):
                continue
            own, starts = np.unique(part["row"].to_numpy(), return_index=True)
            w, scan = part["weight"].to_numpy(np.float64)[:, None], np.searchsorted(places, part["scan"].to_numpy())
            n, squares, n_known, crossed = (np.add.reduceat(x, starts) for x in (rows[scan], w * w * rows[scan], known[scan], w * total[scan]))
            s, f = np.nonzero(n)
            error = pa.array(crossed[s, f] / np.maximum(n_known[s, f], 1.0), pa.float64(), mask=n_known[s, f] == 0)
            columns = [folds[c].combine_chunks().take(pa.array(f)) for c in FOLD]
            triplets = sentences["triplet_row_index"].combine_chunks().take(pa.array(own[s]))
            made.append(pa.table([*columns, triplets, pa.array(squares[s, f] / n[s, f]), error], names=made[0].column_names))
        return pa.concat_tables(made)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _listed(column: pa.ChunkedArray, *fields: str) -> pd.DataFrame:
    """Elements of a column of lists with the number of their row; of structs the named fields, ``missing`` tells a null of the last one."""
    lists = column.combine_chunks()
    values = lists.flatten()
    out = {"row": pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)}
    if not fields:
        return pd.DataFrame(out | {"value": values.to_numpy(zero_copy_only=False)})
    parts = dict(zip(fields, [values.field(values.type.get_field_index(f)) for f in fields]))
    out |= {f: p.to_numpy(zero_copy_only=False) for f, p in parts.items()}
    return pd.DataFrame(out | {"missing": pc.is_null(parts[fields[-1]]).to_numpy(zero_copy_only=False)})


def score_words(changes: DataFrame, models: DataFrame, moments: DataFrame) -> DataFrame:
    """Attribution of every candidate word for every subject; sentences with an empty window drop out.

    ``changes`` has (model, language = target, block, state, canonical_run, triplet_row_index, word columns.., delta).
    """
    folds = models.select(*FOLD, "w").join(moments, FOLD).withColumnRenamed("canonical_run", "_run")
    g = F.col("_g")
    # Dealt by setting and sentence, which ranks and plans within (subject, sentence) go on with.
    return (
        changes.join(folds, [*SETTING, "triplet_row_index"])
        .where(F.col("canonical_run") == F.col("_run"))
        .drop("_run")
        .withColumn("_g", dot(F.col("delta"), F.col("w")))
        .withColumn("attribution_score", g * g * F.col("weight_sq") - F.lit(2.0) * g * F.col("weight_error"))
        .drop("_g", "w", "delta", "weight_sq", "weight_error")
    )


def demand_scope(scoped: DataFrame) -> DataFrame:
    kept = scoped.where("kept")
    if not kept.take(1):
        demand_empty(scoped.select("model", "language", "scope_reason"), "Token scope removed every setting")
    return kept
