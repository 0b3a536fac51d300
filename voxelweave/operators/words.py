"""Word tables: segmentation with offsets, token classes, word-to-subword mapping, subsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voxelweave.functions.text import (
    EN_FUNCTION_WORDS, FR_FUNCTION_WORDS, LATIN_TOKENS, PUNCTUATION, ZH_TOKENS,
)
from voxelweave.session import spread


SPACE, SPOKEN, PUNCT = 0, 1, 2
PLACES = T.ArrayType(T.StructType([T.StructField(c, T.BooleanType() if c == "edge" else T.IntegerType()) for c in ("end", "word", "kind", "edge", "n_subwords")]))


def _places(codes: pa.Array, offsets: pa.Array | None = None) -> pa.Array:
    """For each piece of a sentence its end, the number of its word, its kind, whether it is the first or last one spoken, and the subwords from
    the first to the last that overlap it. ``codes``: 4 x length + kind of each piece; ``offsets``: (start, end) of the subwords."""
    counts = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row, heads = np.repeat(np.arange(len(counts)), counts), np.append(0, np.cumsum(counts))[:-1]
    size, kind = values >> 2, values & 3

    def running(x: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(x))
        return total[1:] - np.repeat(total[heads], counts)

    end, word = running(size), running(kind != SPACE) - 1
    spoken, edge = np.flatnonzero(kind == SPOKEN), np.zeros(len(values), bool)
    change = np.flatnonzero(np.diff(row[spoken]))
    if len(spoken):
        edge[spoken[np.concatenate([[0], change + 1, change, [len(spoken) - 1]])]] = True
    n = np.zeros(len(values), np.int64) if offsets is None else _overlaps(row, end - size, end, offsets)
    places = [pa.array(end.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(edge), pa.array(n.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), pa.StructArray.from_arrays(places, names=PLACES.elementType.names))


def _overlaps(row: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: pa.Array) -> np.ndarray:
    """Subwords from the first to the last that overlap [start, end) of a row, half-open; those without width are counted in between only."""
    counts = pc.fill_null(pc.list_value_length(offsets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    low, high = (pc.fill_null(p, 0).to_numpy(zero_copy_only=False).astype(np.int64) for p in offsets.flatten().flatten())
    wide = np.flatnonzero(high > low)
    low, high, owner = low[wide], high[wide], np.repeat(np.arange(len(counts)), counts)[wide]
    falls = (np.diff(owner) == 0) & ((np.diff(low) < 0) | (np.diff(high) < 0))
    far = 1 << 32
    first = np.searchsorted(owner * far + high, row * far + start, "right") if not falls.any() else None
    if first is not None:
        last = np.searchsorted(owner * far + low, row * far + end, "left") - 1
        hit = (first <= last) & (end > start)
        return np.where(hit, wide[np.where(hit, last, 0)] - wide[np.where(hit, first, 0)] + 1, 0) if len(wide) else np.zeros(len(row), np.int64)
    heads, n = np.searchsorted(owner, np.arange(len(counts) + 1)), np.zeros(len(row), np.int64)
    for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), end.tolist())):  # subwords in any order
        own = slice(heads[r], heads[r + 1])
        found = wide[own][(low[own] < e) & (high[own] > s)]
        n[i] = found[-1] - found[0] + 1 if len(found) and e > s else 0
    return n


@F.arrow_udf(PLACES)
def _word_places(codes: pa.Array) -> pa.Array:
    return _places(codes)


@F.arrow_udf(PLACES)
def _mapped_places(codes: pa.Array, offsets: pa.Array) -> pa.Array:
    return _places(codes, offsets)


def segment_words(
    sentences: DataFrame, keys: Sequence[str], text: str = "text", language: str = "language", offsets: str | None = None, deal: Sequence[str] | None = None
) -> DataFrame:
    """Words of every sentence with character offsets and token class; with ``offsets``, the column of the subwords' (start, end), also
    ``n_subwords_deleted``, from the first to the last subword that overlaps the word.

    Tokens and the white space between them cover the whole text, so offsets are running lengths. The sentences are distributed by
    key (by ``deal``, some of the keys, if given) once, before they are split; lengths are summed inside each sentence, and the exploded
    words are neither sorted nor shuffled.
    """
    sentences = spread(sentences, *(deal or keys))
    pieces = F.when(
        F.col(language) == "ZH", F.regexp_extract_all(text, F.lit(ZH_TOKENS + r"|\s+"), F.lit(0))
    ).otherwise(F.regexp_extract_all(text, F.lit(LATIN_TOKENS + r"|\s+"), F.lit(0)))
    split = sentences.select(*keys, F.col(language).alias("_lang"), pieces.alias("_pieces"), *([F.col(offsets).alias("_offsets")] if offsets else []))
    def kind(p: Column) -> Column:  # regular expressions only where the first character or the length leave it open
        plain = F.ascii(p)
        space = plain.between(9, 13) | (plain == 32) | ((plain >= 128) & p.rlike(r"(?U)^\s"))
        return F.when(space, SPACE).when((F.length(p) == 1) & p.rlike(PUNCTUATION), PUNCT).otherwise(SPOKEN)

    codes = F.transform("_pieces", lambda p: F.length(p) * 4 + kind(p))
    split = split.withColumn("_places", _mapped_places(codes, F.col("_offsets")) if offsets else _word_places(codes))
    each = split.select(*keys, "_lang", F.explode(F.arrays_zip("_pieces", "_places")).alias("_p"))
    rows = each.select(
        *keys, "_lang", F.col("_p._places.word").alias("word_index"), F.col("_p._pieces").alias("word_text"),
        (F.col("_p._places.end") - F.length("_p._pieces")).alias("word_char_start"), F.col("_p._places.end").alias("word_char_end"),
        F.col("_p._places.edge").alias("_edge"), F.col("_p._places.n_subwords").alias("n_subwords_deleted"),
        (F.col("_p._places.kind") == PUNCT).alias("_punct"), (F.col("_p._places.kind") == SPACE).alias("_space"),
    ).where(~F.col("_space"))
    lowered = F.lower("word_text")
    function = ((F.col("_lang") == "EN") & lowered.isin(*EN_FUNCTION_WORDS)) | (
        (F.col("_lang") == "FR") & lowered.isin(*FR_FUNCTION_WORDS)
    )
    token_class = (
        F.when(F.col("_punct"), "PUNCT").when(F.col("_edge"), "EDGE").when(function, "FUNCTION").otherwise("CONTENT")
    )
    return rows.select(
        *keys, "word_index", "word_text", "word_char_start", "word_char_end",
        F.when(F.col("_punct"), F.lit("PUNCT")).alias("upos"),
        token_class.alias("token_class"), *(["n_subwords_deleted"] if offsets else []),
    )


def map_words_to_subwords(words: DataFrame, subwords: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """First and last subword overlapping each word; gaps are filled, zero-width subwords ignored.

    Half-open overlap as an equi-join on (sentence, character bin), so long texts do not pair all words
    with all subwords. Words without an overlap keep NULL bounds and count 0.
    """
    def bins(start: str, end: str):
        return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))

    spans = words.select(*keys, "word_index", "word_char_start", "word_char_end", bins("word_char_start", "word_char_end").alias("_bin"))
    pieces = subwords.where(F.col("sub_end") > F.col("sub_start")).select(
        *keys, "sub_index", "sub_start", "sub_end", bins("sub_start", "sub_end").alias("_bin")
    )
    hits = (
        spans.join(pieces, [*keys, "_bin"])
        .where((F.col("sub_start") < F.col("word_char_end")) & (F.col("sub_end") > F.col("word_char_start")))
        .groupBy(*keys, "word_index")
        .agg(F.min("sub_index").alias("first_subword"), F.max("sub_index").alias("last_subword"))
    )
    return words.join(hits, [*keys, "word_index"], "left").withColumn(
        "n_subwords_deleted", F.coalesce(F.col("last_subword") - F.col("first_subword") + 1, F.lit(0))
    )


def subword_rows(metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offsets of a token metadata table as rows."""
    return metadata.select(*keys, F.posexplode("char_offsets").alias("sub_index", "_span")).select(
        *keys, "sub_index", F.col("_span.start").alias("sub_start"), F.col("_span.end").alias("sub_end")
    )


def parse_token_json(metadata: DataFrame) -> DataFrame:
    """JSON text columns of an imported token table to arrays."""
    pairs = F.from_json("char_offsets_json", "array<array<int>>")
    return (
        metadata.withColumn("token_strings", F.from_json("token_strings_json", "array<string>"))
        .withColumn("char_offsets", F.transform(pairs, lambda p: F.struct(p[0].alias("start"), p[1].alias("end"))))
        .drop("token_strings_json", "char_offsets_json")
    )


def token_subset(triplets: DataFrame, per_run: int, name: str, languages: Sequence[str]) -> DataFrame:
    """First ``per_run`` triplets of each run by row index, ranked 1.., for every target language."""
    rank = F.row_number().over(Window.partitionBy("canonical_run").orderBy("triplet_row_index"))
    targets = F.explode(F.array(*[F.lit(lang) for lang in languages])).alias("target_language")
    return (
        triplets.select("canonical_run", "triplet_id", "triplet_row_index")
        .withColumn("token_subset_rank", rank)
        .where(F.col("token_subset_rank") <= per_run)
        .select(
            targets, F.col("canonical_run").cast("bigint").alias("canonical_run"),
            F.col("triplet_id").cast("string").alias("triplet_id"),
            F.col("triplet_row_index").cast("bigint").alias("triplet_row_index"),
            F.lit(name).alias("token_subset_name"), "token_subset_rank",
        )
    )


def underfilled_runs(triplets: DataFrame, per_run: int) -> DataFrame:
    return triplets.groupBy("canonical_run").agg(F.count(F.lit(1)).alias("n_triplets")).where(F.col("n_triplets") < per_run)


def subset_triplets(triplets: DataFrame, subset: DataFrame) -> DataFrame:
    """Subset rows LEFT JOIN triplets after casting the keys, without rows lacking a key."""
    cast = triplets.withColumns(
        {
            "triplet_id": F.col("triplet_id").cast("string"),
            "triplet_row_index": F.col("triplet_row_index").cast("bigint"),
            "canonical_run": F.col("canonical_run").cast("bigint"),
        }
    )
    return subset.join(cast, ["triplet_id", "triplet_row_index", "canonical_run"], "left").where(
        F.col("triplet_id").isNotNull() & F.col("triplet_row_index").isNotNull()
    )


def fill_row_index(rows: DataFrame, triplets: DataFrame) -> DataFrame:
    """Look a missing triplet_row_index up by triplet_id; rows without a match are dropped."""
    if "triplet_row_index" in rows.columns:
        return rows
    return rows.join(triplets.select("triplet_id", "triplet_row_index"), "triplet_id", "left").where("triplet_row_index IS NOT NULL")


def sentence_candidates(
    sentences: DataFrame, metadata: DataFrame, keys: Sequence[str], language: str = "sentence_language", deal: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Words that can be deleted, and the failures with their reason.

    ``sentences`` lists the (keys.., language) wanted; ``metadata`` holds text, has_offset_mapping and
    char_offsets per key. Failures: no metadata, no offsets (both as one sentence row with word index -1),
    or a word that no subword overlaps.
    """
    wanted = sentences.select(*keys).distinct()
    joined = wanted.join(metadata.select(*keys, "text", "has_offset_mapping", "char_offsets").withColumn("_has", F.lit(True)), list(keys), "left")
    reason = F.when(F.col("_has").isNull(), "missing_token_metadata").when(~F.col("has_offset_mapping"), "offset_mapping_failed")
    joined = joined.withColumn("failure_reason", reason)
    nothing = [F.lit(-1).alias("word_index"), F.lit("").alias("word_text"), F.lit(-1).alias("word_char_start"), F.lit(-1).alias("word_char_end")]
    sentence_failures = joined.where("failure_reason IS NOT NULL").select(*keys, *nothing, "failure_reason")
    usable = joined.where("failure_reason IS NULL")
    mapped = segment_words(usable, keys, "text", language, "char_offsets", deal)
    word_failures = mapped.where("n_subwords_deleted = 0").select(
        *keys, "word_index", "word_text", "word_char_start", "word_char_end", F.lit("offset_mapping_failed").alias("failure_reason")
    )
    candidates = mapped.where("n_subwords_deleted > 0").withColumn("mapping_status", F.lit("OK"))
    failures = sentence_failures.unionByName(word_failures).withColumn("mapping_status", F.lit("FAILED"))
    return candidates, failures
