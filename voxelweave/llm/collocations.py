"""Phrase collocations by Toivonen's sampling.

A deterministic sample of the documents proposes phrases of up to three words that look frequent at a lowered threshold, level by
level. One pass over all texts then counts, exactly, every word and every phrase of two to four words whose two shorter parts
(all but the last word, all but the first) were proposed: the proposals and their negative border at once. A frequent phrase of
the border that was not proposed is a failure: longer phrases around it may have been missed. An expansion pass counts the phrases
of which one part is such a failure and the other is frequent. A part that this pass counts itself is taken as a possible failure, so
longer phrases are counted at once with their parts, and one expansion closes all levels: every part of a frequent phrase is
frequent, so it was counted before or is counted in the same pass.

A phrase is the tuple of 64-bit hashes of its words, each with its language; that no frequent word shares its hash with any other
word is checked, and another seed is taken if one does. Tasks ask a Bloom filter of bounded size whether a part was proposed. Its
false positives only make a task count a phrase in vain: whether a phrase is frequent is decided by exact counts alone.

Tasks count a bounded number of words at a time with numpy and hand partial counts to Spark's aggregation, which combines them
before the shuffle. Long texts are read piece by piece with three words carried over, so phrases across the cut are counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import sized, stored
from voxelweave.llm.toxicity import slices

LONGEST = 4
KEY = ["w1", "w2", "w3", "w4"]
FLUSH_WORDS = 1_000_000
PIECE_BYTES = 1 << 20
BLOOM_BITS = 1 << 27
PROBES = 2
SEED = 42
#: Lower-case A-Z; what ends a piece becomes a full stop, which no word contains.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_BREAK = re.compile(rb"[ \t.]")
_COUNTED = "kind int, lang string, word string, w1 long, w2 long, w3 long, w4 long, n long"


class _Hashes(dict):
    """Hash of each word of one language; 0 for the end of a piece."""

    def __init__(self, lang: str, seed: int) -> None:
        super().__init__({b".": 0})
        self.lang, self.seed = lang.encode() + b"\x00", seed

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(self.lang + word, self.seed) or 1
        return found


def _mix(words: Sequence[np.ndarray]) -> np.ndarray:
    """One well-mixed number for each tuple of word hashes."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _probes(mixed: np.ndarray, bits: int) -> list[np.ndarray]:
    again = (mixed ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
    again ^= again >> np.uint64(32)
    return [x & np.uint64(bits - 1) for x in (mixed, again)][:PROBES]


def _contains(bloom: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    found = np.ones(len(mixed), bool)
    for at in _probes(mixed, len(bloom) * 64):
        found &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def bloom_filter(phrases: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of the phrases (w1..w4); what reaches the driver is at most ``bits`` bits, however many phrases there are."""
    bits = min(bits, 1 << max(16, (32 * phrases.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            size = sum((w != 0).astype(int) for w in words)
            found = []
            for k in range(1, LONGEST + 1):
                rows = size == k
                found += _probes(_mix([w[rows] for w in words[:k]]), bits)
            at = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], names=["at", "bit"])

    words = phrases.select(*KEY).mapInArrow(places, "at long, bit int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bloom


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _grams(hashes: np.ndarray, carried: int, filters: Sequence[tuple | None]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(word columns, counts) of the phrases of two to four words that the filters let through and that end behind ``carried``.

    filters[k - 1] judges the parts of k words: (known, new); a phrase is counted if both its parts are known and, unless new is
    None, one of them is new. What is counted because of a new part is itself taken as known and new. None counts no longer phrases.
    """
    n = len(hashes)
    pending = np.zeros(n, bool)
    for k in range(1, LONGEST):
        if filters[k - 1] is None or n <= k:
            return
        known, new = filters[k - 1]
        if k == 1:
            ends = np.flatnonzero(hashes)
        mixed = _mix([hashes[ends - k + 1 + j] for j in range(k)])
        inside = _contains(known, mixed) | pending[ends]
        ends, mixed = ends[inside], mixed[inside]
        here = np.zeros(n, bool)
        here[ends] = True
        longer = here[1:] & here[:-1]
        if new is not None:
            fresh = np.zeros(n, bool)
            fresh[ends] = _contains(new, mixed) | pending[ends]
            counted = longer & (fresh[1:] | fresh[:-1])
            pending = np.append(False, counted)
        else:
            counted = longer
        at = np.flatnonzero(counted) + 1
        at = at[at >= carried]
        if len(at):
            columns = [hashes[at - k + j] for j in range(k + 1)]
            order = np.argsort(_mix(columns))
            columns = [c[order] for c in columns]
            first = np.ones(len(at), bool)
            first[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
            starts = np.flatnonzero(first)
            yield [c[starts] for c in columns], np.diff(np.append(starts, len(at)))
        ends = np.flatnonzero(longer) + 1


def _batch(kind: int, columns: list, counts, lang=None, words=None) -> pa.RecordBatch:
    n = len(counts)
    none = pa.nulls(n, pa.string())
    longs = [pa.array(c.view(np.int64)) for c in columns] + [pa.array(np.zeros(n, np.int64))] * (LONGEST - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), none if lang is None else pa.array([lang] * n, pa.string()), none if words is None else words, *longs, pa.array(np.asarray(counts, np.int64))],
        names=["kind", "lang", "word", *KEY, "n"],
    )


def count_phrases(
    documents: DataFrame, filters: Sequence[tuple | None], words: bool, seed: int = SEED, flush_words: int = FLUSH_WORDS, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Partial counts (kind: 1 for words, else the length; lang and word for words; w1..w4; n) of all texts."""
    shared = documents.sparkSession.sparkContext.broadcast(list(filters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, _Hashes] = {}
        counters: dict[str, Counter] = {}
        parts: list[np.ndarray] = []
        held = carried = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                for lang, counter in counters.items():
                    counter.pop(b".", None)
                    keys = list(counter)
                    column = np.fromiter(map(names[lang].__getitem__, keys), np.uint64, len(keys))
                    yield _batch(1, [column], list(counter.values()), lang, pa.array(keys, pa.binary()).cast(pa.string()))
            for columns, counts in _grams(np.concatenate(parts), carried, shared.value):
                yield _batch(len(columns), columns, counts)

        for batch in slices(batches, 500):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in _pieces((text.as_py() or "").encode().translate(FOLD), piece_bytes):
                    tokens = piece.replace(b".", b" . ").split()
                    if lang not in names:
                        names[lang] = _Hashes(lang, seed)
                    parts.append(np.fromiter(map(names[lang].__getitem__, tokens), np.uint64, len(tokens)))
                    if words:
                        counters.setdefault(lang, Counter()).update(tokens)
                    held += len(tokens)
                    if held >= flush_words:
                        yield from flush()
                        tail = np.concatenate(parts)[-(LONGEST - 1) :]
                        names, counters, parts, held, carried = {}, {}, [tail], 0, len(tail)
                parts.append(np.zeros(1, np.uint64))
        if parts:
            yield from flush()

    read = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return read.mapInArrow(run, _COUNTED)


def _phrases(counted: DataFrame) -> DataFrame:
    return counted.where("kind > 1").groupBy(*KEY).agg(F.sum("n").alias("f"))


def _words(counted: DataFrame) -> DataFrame:
    return counted.where("kind = 1").groupBy("lang", "word", "w1").agg(F.sum("n").alias("f"))


def size_of(key: Sequence[str] = KEY) -> Column:
    return sum((F.col(c) != 0).cast("int") for c in key)


def propose(sample: DataFrame, least: int, seed: int, **how: int) -> list[DataFrame]:
    """Phrases of one, two and three words with ``least`` occurrences in the sample, level by level."""
    every = np.full(1 << 10, (1 << 64) - 1, np.uint64)
    zero = F.lit(0).cast("long")
    levels = [_words(count_phrases(sample, [None], True, seed, **how)).where(F.col("f") >= least).select("w1", *[zero.alias(c) for c in KEY[1:]])]
    levels[0] = stored(levels[0].distinct(), "proposed")
    for k in (1, 2):
        before = bloom_filter(levels[-1])
        filters = [(every, None)] * (k - 1) + [(before, None), None, None]
        found = _phrases(count_phrases(sample, filters, False, seed, **how).where(F.col("kind") == k + 1))
        levels.append(stored(found.where(F.col("f") >= least).select(*KEY), "proposed"))
    return levels


def frequent_phrases(documents: DataFrame, least: int = 30, share: int = 16, seed: int = SEED, **how: int) -> tuple[DataFrame, DataFrame, int]:
    """(words: lang, word, w1, f of all words; phrases: w1..w4, f of two to four words with f >= ``least``; expansion passes)."""
    texts = documents.select("doc_id", "lang", "text")
    sample = stored(texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0), "sample")
    proposed = propose(sample, max(2, least // share), seed, **how)
    filters = [(bloom_filter(level), None) for level in proposed]
    counted = stored(_both(count_phrases(texts, filters, True, seed, **how), least), "counted")
    words = counted.where("kind = 1").select("lang", "word", "w1", "f")
    often = words.where(F.col("f") >= least)
    clash = words.join(often.select("w1").distinct(), "w1").groupBy("w1").agg(F.count("*").alias("c")).where("c > 1")
    if not clash.isEmpty():  # two words, one hash: count again with other hashes
        return frequent_phrases(documents, least, share, seed + 1, **how)
    phrases = counted.where("kind > 1").select(*KEY, "f")
    zero = F.lit(0).cast("long")
    known = often.select("w1", *[zero.alias(c) for c in KEY[1:]]).union(phrases.where("w4 = 0").select(*KEY))
    failed = stored(known.join(reduce(DataFrame.union, proposed), KEY, "left_anti"), "failures")
    if failed.isEmpty():
        return words, phrases, 0
    filters = [tuple(bloom_filter(df.where(size_of() == k)) for df in (known, failed)) for k in range(1, LONGEST)]
    more = _phrases(count_phrases(texts, filters, False, seed, **how)).where(F.col("f") >= least)
    found = stored(more.join(phrases.select(*KEY), KEY, "left_anti"), "expanded")  # false positives were counted before
    return words, phrases.union(found), 1


def _both(counted: DataFrame, least: int) -> DataFrame:
    """Sums of the partial counts in one pass: all words, and the phrases with ``least`` occurrences."""
    sums = counted.groupBy("kind", "lang", "word", *KEY).agg(F.sum("n").alias("f"))
    return sums.where((F.col("kind") == 1) | (F.col("f") >= least))


def _part(first: Column, size: Column) -> list[Column]:
    """Columns w1..w4 of the contiguous part of ``size`` words from position ``first`` (0) of the array ``words``."""
    return [F.when(F.lit(j) < size, F.get("words", first + j)).otherwise(F.lit(0).cast("long")).alias(f"p{j + 1}") for j in range(LONGEST)]


def collocations(documents: DataFrame, least: int = 30, top: int = 2000, share: int = 16, **how: int) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Only doc_id, lang and text are read, so further columns may have any name. A null lang is ``und``, an empty one a language of its
    own; null and empty texts have no words; a null doc_id only plays a part in sampling. Repeated rows count as often as given; texts
    of any length are read whole. Ties are ordered by a, then by the phrase's bytes. An empty table gives no rows.
    """
    words, phrases, _ = frequent_phrases(documents, least, share, **how)
    zero = F.lit(0).cast("long")
    named = words.where(F.col("f") >= least).select("lang", "word", "w1", "f")
    every = stored(named.select("w1", *[zero.alias(c) for c in KEY[1:]], "f").union(phrases.select(*KEY, "f")), "frequent")
    lookup = every.select(*[F.col(c).alias(f"p{i + 1}") for i, c in enumerate(KEY)], F.col("f").alias("part_f"))
    found = phrases.select(*KEY, F.col("f").alias("a"), F.filter(F.array(*KEY), lambda w: w != 0).alias("words"))
    found = stored(found.withColumn("size", F.size("words")), "candidates")

    places = [f"p{i + 1}" for i in range(LONGEST)]
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = cut.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    start, length = F.when(F.col("side") == 1, F.col("k")).otherwise(0), F.when(F.col("side") == 1, F.col("size") - F.col("k")).otherwise(F.col("k"))
    parts = sides.select(*KEY, "a", "k", "side", *_part(start, length)).join(lookup, places)
    cuts = parts.groupBy(*KEY, "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"))
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * F.col("a").cast("decimal(20,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    weakest = cuts.withColumn("score", score).groupBy(*KEY, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = weakest.select(*KEY, "a", "m.l", "m.r", "m.score")

    inner = found.where("size > 2").withColumn("part", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), s -> transform(sequence(0, size - s), b -> struct(b as b, s as s))))")))
    covered = inner.select(F.col("a").alias("longer"), *_part(F.col("part.b"), F.col("part.s"))).groupBy(*places).agg(F.max("longer").alias("longer"))
    covered = covered.select(*[F.col(p).alias(k) for p, k in zip(places, KEY)], "longer")
    free = stored(scored.join(covered, KEY, "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < 80 * F.col("a"))).select(*KEY, "a", "l", "r", "score"), "scored")

    each = free.select("*", F.posexplode(F.filter(F.array(*KEY), lambda w: w != 0)).alias("at", "hash"))
    spelt = each.join(named.select(F.col("w1").alias("hash"), "lang", "word"), "hash").groupBy(*KEY, "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    spelt = stored(spelt.select("lang", F.array_join(F.col("parts.word"), " ").alias("phrase"), "a", "l", "r", "score"), "spelt")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = spelt.withColumn("near", F.row_number().over(salted)).where(F.col("near") <= top).drop("near")  # a language's first are among its parts' first
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sized(stored(total, "totals")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pc),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, first(ws) AS ws, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
cu AS (SELECT lang, k, g, ws, f, unnest(range(1, k)) AS j FROM c),
sc AS (SELECT cu.lang, cu.g, cu.ws, cu.f AS a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * cu.f) // (x.f + y.f) AS score
  FROM cu JOIN f x ON x.lang = cu.lang AND x.g = array_to_string(cu.ws[1:j], ' ') JOIN f y ON y.lang = cu.lang AND y.g = array_to_string(cu.ws[j + 1:], ' ')),
lo AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ps AS (SELECT lang, f, k, ws, s, unnest(range(1, k - s + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS s FROM c)),
inn AS (SELECT lang, array_to_string(ws[b:b + s - 1], ' ') AS g, max(f) AS f FROM ps GROUP BY ALL),
kp AS (SELECT lo.* FROM lo LEFT JOIN inn USING (lang, g) WHERE inn.f IS NULL OR 100 * inn.f < 80 * a),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kp)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM rk JOIN n USING (lang) WHERE rank <= 2000
"""
