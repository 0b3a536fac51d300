"""Source divergence audit: how far the sources of a language differ in their use of words.

A CountVectorizer with a minimum document frequency and the largest vocabulary size turns every text into an exact sparse vector.
Terms carry their language, so that one fit keeps each language's own terms: those of enough of its documents. Sparse vectors
are summed by (language, source), as a Summarizer does, but as whole numbers and entry by entry, never as dense buffers.

Two sources are compared over the union of their terms only: all other terms have the same two smoothed shares and count as one
product. Terms are dealt into blocks of ``BLOCK_TERMS``; a task holds one block of one language, so its size is bounded by the
number of sources times the block, whatever the vocabulary.

A fitted vocabulary passes through the driver. ``shards`` fits, each over the terms of one hash class, bound it at about
``TERMS_PER_FIT`` terms, and documents' vectors are then summed shard by shard. Their number follows from the different terms in a
sixteenth of the documents: a term of 30 documents is among them with probability 0.85, a commoner one more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import stored
from voxelweave.llm.toxicity import slices

#: Lower-case A-Z; ASCII that is no letter separates terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
BILLION = 1_000_000_000
SMOOTH = 5
BLOCK_TERMS = 4_096
TERMS_PER_FIT = 4_000_000
MARK = "\x00"  # never part of a term; the last one ends the language


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def tokens(documents: DataFrame) -> DataFrame:
    """(lang, source, terms: the text's terms in order, each behind its language and a mark), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            folded = [(t.as_py() or "").encode().translate(FOLD).strip() or None for t in batch.column(2)]
            words = pc.ascii_split_whitespace(pa.array(folded, pa.binary()).cast(pa.string()))
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            marks = pc.binary_join_element_wise(batch.column(0), pa.scalar(MARK), "").take(pa.array(np.repeat(np.arange(len(n)), n)))
            terms = pc.binary_join_element_wise(marks, pc.list_flatten(words), "")
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, terms)], names=["lang", "source", "terms"])

    return documents.select(_plain("lang"), _plain("source"), "text").mapInArrow(run, "lang string, source string, terms array<string>")


def vocabulary_shards(documents: DataFrame) -> int:
    sixteenth = documents.where(F.pmod(F.xxhash64("text", "source"), F.lit(16)) == 0)
    seen = tokens(sixteenth).select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    return max(1, -(-seen * 13 // 10 // TERMS_PER_FIT))


def _fit(texts: DataFrame, min_df: int) -> tuple[DataFrame, list[str]] | None:
    """Texts with their sparse vectors and the vocabulary; None if no term is frequent enough."""
    try:
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=2**31 - 1).fit(texts)
    except IllegalArgumentException as error:
        if "vocabulary size should be > 0" in str(error):
            return None
        raise
    return model.transform(texts), model.vocabulary


def group_counts(documents: DataFrame, min_df: int = 30, shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source), (counts: lang, source, term, n > 0), (kept: lang, term), all stored."""
    texts = stored(tokens(documents), "tokens")
    groups = stored(texts.select("lang", "source").distinct(), "groups")
    shards = shards or vocabulary_shards(documents)
    counts = kept = None
    for k in range(shards):
        mine = texts if shards == 1 else texts.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(shards)) == k))
        fitted = _fit(mine, min_df)
        if fitted is None:
            continue
        vectors, vocabulary = fitted
        raw = F.unwrap_udt("vector")
        entries = vectors.select("source", raw["indices"].alias("places"), F.posexplode(raw["values"]).alias("i", "n"))
        sums = entries.groupBy("source", F.get("places", F.col("i")).alias("at")).agg(F.sum(F.col("n").cast("long")).alias("n"))
        parts = [v.rpartition(MARK) for v in vocabulary]  # a term's place tells its language
        names = pa.table({"at": pa.array(np.arange(len(vocabulary), dtype=np.int32)), "lang": [v[0] for v in parts], "term": [v[2] for v in parts]})
        table = documents.sparkSession.createDataFrame(names)
        here = stored(sums.join(table, "at").select("lang", "source", "term", "n"), "counts")
        counts = here if counts is None else counts.union(here)
    if counts is None:
        counts = documents.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    kept = stored(counts.select("lang", "term").distinct(), "kept")
    return groups, counts, kept


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) in whole numbers beyond 64 bits."""
    over = F.lit(BILLION).cast("decimal(12,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", over, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def _apart(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of terms of one language: for each two sources the sum of |p - q| less |base p - base q| over the terms of either.

    Rows with a null term name the sources and give the share of a term that they do not have.
    """
    bases = rows[rows["term"].isna()].sort_values("source")
    names, base = bases["source"].tolist(), bases["p"].to_numpy(np.int64)
    entries = rows[rows["term"].notna()]
    ids = pd.factorize(entries["term"])[0]
    own, p = entries["source"].to_numpy(), entries["p"].to_numpy(np.int64)
    order = np.lexsort((ids, own))
    ids, own, p = ids[order], own[order], p[order]
    ends = np.searchsorted(own, names, side="right") if len(own) else np.zeros(len(names), int)
    starts = np.searchsorted(own, names, side="left") if len(own) else ends
    out = []
    for i in range(len(names)):
        a, pa_ = ids[starts[i] : ends[i]], p[starts[i] : ends[i]]
        for j in range(i + 1, len(names)):
            b, pb = ids[starts[j] : ends[j]], p[starts[j] : ends[j]]
            at = np.searchsorted(b, a)
            hit = at < len(b)
            hit[hit] = b[at[hit]] == a[hit]
            lone = np.ones(len(b), bool)
            lone[at[hit]] = False
            total = np.abs(pa_[hit] - pb[at[hit]]).sum() + np.abs(pa_[~hit] - base[j]).sum() + np.abs(base[i] - pb[lone]).sum()
            union = len(a) + int(lone.sum())
            out.append((key[0], names[i], names[j], int(total) - union * int(abs(base[i] - base[j]))))
    return pd.DataFrame(out, columns=["lang", "a", "b", "part_sum"])


def divergence(documents: DataFrame, min_df: int = 30, top: int = 50, block_terms: int = BLOCK_TERMS, shards: int | None = None) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` gives every other source of the language by distance, ``term`` the
    ``top`` terms that a source uses more than its language does.

    Only text, lang and source are read, so further columns may have any name; nulls in them count as empty strings. A group whose
    texts have no terms takes part with its smoothed shares. A language without kept terms has pairs of value 0 and no terms.
    Ties go by item, in the order of UTF-8 bytes. Repeated rows are documents of their own; texts of any length are read whole.
    An empty table gives no rows.
    """
    groups, counts, kept = group_counts(documents, min_df, shards)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    known = known.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    base = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / block_terms))
    known = stored(known.select("*", base.alias("base"), blocks.alias("blocks")), "groups_known")

    entries = counts.join(known, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "blocks")
    entries = stored(entries, "entries")
    dealt = entries.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    named = known.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    parts = dealt.unionByName(named).groupBy("lang", "block").applyInPandas(_apart, "lang string, a string, b string, part_sum long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part_sum").alias("part_sum"))
    first = known.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "terms")
    second = known.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    full = sums.join(first, ["lang", "a"]).join(second, ["lang", "b"])
    pairs = stored(full.select("lang", "a", "b", (F.col("part_sum") + F.col("terms") * F.abs(F.col("base_a") - F.col("base_b"))).alias("value")), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    of_lang = entries.groupBy("lang", "term").agg(F.sum("n").alias("n_all"))
    lang_total = known.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"))
    usual = of_lang.join(lang_total, "lang").select("lang", "term", share(F.col("n_all"), F.col("all"), F.col("terms")).alias("q"))
    more = entries.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(both, "pair").union(ranked(more, "term").where(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
tot AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM f GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM f JOIN tot USING (lang, source)),
fl AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
tl AS (SELECT lang, sum(n) AS total, count(*) AS v FROM fl GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM fl JOIN tl USING (lang)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM rk WHERE part = 'pair' OR rank <= 50
"""
