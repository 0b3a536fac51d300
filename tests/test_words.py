import random

import pytest
import regex
from pyspark.sql import functions as F

from voxelweave.functions import text as T
from voxelweave.operators import words

LATIN = regex.compile(r"\p{L}+(?:['’-]\p{L}+)*|\p{N}+|[^\p{L}\p{N}\s]", regex.V1)
HAN = regex.compile(r"\p{Han}|[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", regex.V1)


def segment(spark, items):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(items)], "i int, language string, text string")
    out = {i: [] for i in range(len(items))}
    for r in words.segment_words(df, ["i"]).orderBy("i", "word_index").collect():
        out[r.i].append((r.word_text, r.word_char_start, r.word_char_end, r.token_class, r.word_index))
    return out


def test_chinese_example(spark):
    got = segment(spark, [("ZH", "甲乙，丙")])[0]
    assert [g[:4] for g in got] == [("甲", 0, 1, "EDGE"), ("乙", 1, 2, "CONTENT"), ("，", 2, 3, "PUNCT"), ("丙", 3, 4, "EDGE")]


def test_classes(spark):
    got = segment(spark, [("EN", "(The cat + the dog's tail.)"), ("FR", "L’été et la mer"), ("ZH", "the A丙 the 乙"), ("EN", "... !"), ("EN", "")])
    assert [(w, c) for w, _, _, c, _ in got[0]] == [
        ("(", "PUNCT"), ("The", "EDGE"), ("cat", "CONTENT"), ("+", "CONTENT"), ("the", "FUNCTION"), ("dog's", "CONTENT"), ("tail", "EDGE"), (".", "PUNCT"), (")", "PUNCT"),
    ]
    assert [(w, c) for w, _, _, c, _ in got[1]] == [("L’été", "EDGE"), ("et", "FUNCTION"), ("la", "FUNCTION"), ("mer", "EDGE")]
    assert [(w, c) for w, _, _, c, _ in got[2]] == [("the", "EDGE"), ("A丙", "CONTENT"), ("the", "CONTENT"), ("乙", "EDGE")]
    assert [c for *_, c, _ in got[3]] == ["PUNCT"] * 4 and got[4] == []


def test_offsets_against_regex(spark):
    rng = random.Random(1)
    alphabet = "ab éÉ'’-.,+3४  　\n\t甲乙😀é"
    items = [(lang, "".join(rng.choice(alphabet) for _ in range(60))) for lang in ("EN", "FR", "ZH") for _ in range(25)]
    got = segment(spark, items)
    for i, (lang, text) in enumerate(items):
        want = [(m.group(), m.start(), m.end()) for m in (HAN if lang == "ZH" else LATIN).finditer(text)]
        assert [g[:3] for g in got[i]] == want
        assert [g[4] for g in got[i]] == list(range(len(want)))


def test_subword_mapping(spark):
    spans = [(0, 3), (4, 9), (10, 12), (200, 210)]
    subs = [(0, 0), (0, 2), (2, 4), (4, 5), (7, 9), (5, 5), (150, 205), (205, 300)]
    w = spark.createDataFrame([(1, i, *s) for i, s in enumerate(spans)], "k int, word_index int, word_char_start int, word_char_end int")
    p = spark.createDataFrame([(1, i, *s) for i, s in enumerate(subs)], "k int, sub_index int, sub_start int, sub_end int")
    got = {r.word_index: (r.first_subword, r.last_subword, r.n_subwords_deleted) for r in words.map_words_to_subwords(w, p, ["k"], width=4).collect()}
    for i, (a, b) in enumerate(spans):
        hit = [j for j, (s, e) in enumerate(subs) if e > s and s < b and e > a]
        assert got[i] == ((min(hit), max(hit), max(hit) - min(hit) + 1) if hit else (None, None, 0))


def test_words_are_neither_sorted_nor_shuffled_and_meet_subwords_in_place(spark):
    """Against a plain scan: subwords with gaps, without width, out of order, missing; null, empty and long texts."""
    rng = random.Random(4)
    rows = [(0, "EN", None, [(0, 2)]), (1, "EN", "", []), (2, "FR", "la vie. la", None), (3, "ZH", "甲 乙，丙", [(3, 5), (0, 1), (0, 9)]), (4, "EN", " ".join(["word,"] * 3000), [(i, i + 7) for i in range(0, 17000, 7)])]
    for i in range(5, 60):
        text = "".join(rng.choice("abc é'-.,+3　 \n甲乙😀") for _ in range(rng.randrange(50)))
        subs = [(s, s + rng.randrange(4)) for s in sorted(rng.randrange(55) for _ in range(rng.randrange(20)))]
        rows.append((i, rng.choice(["EN", "FR", "ZH"]), text, rng.sample(subs, len(subs)) if i % 4 == 0 else subs))
    df = spark.createDataFrame(rows, "k int, language string, text string, subs array<struct<start:int,end:int>>")
    found = words.segment_words(df, ["k"], offsets="subs")
    got = {(r.k, r.word_char_start, r.word_char_end, r.word_index, r.n_subwords_deleted) for r in found.collect()}
    want = set()
    for k, lang, text, subs in rows:
        for i, m in enumerate((HAN if lang == "ZH" else LATIN).finditer(text or "")):
            hit = [j for j, (s, e) in enumerate(subs or []) if e > s and s < m.end() and e > m.start()]
            want.add((k, m.start(), m.end(), i, max(hit) - min(hit) + 1 if hit else 0))
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Sort [", "Window [", "Join ")) and plan.count("RepartitionBy") == 1


def drop(text, start, end, lang):
    text = text[:start] + text[end:]
    return regex.sub(r"\s+", " ", text).strip() if lang in ("EN", "FR") else text


def test_span_deletion(spark):
    cases = [("EN", "  one two  three", [(2, 5), (6, 9)]), ("ZH", "甲 乙，丙", [(0, 1), (3, 4)]), ("FR", "a b c", [(2, 3)]), ("EN", "x", [(0, 1)])]
    df = spark.createDataFrame([(i, lang, text, spans) for i, (lang, text, spans) in enumerate(cases)], "i int, lang string, text string, spans array<struct<start:int,end:int>>")
    one = F.col("spans")[0]
    got = df.select("i", T.delete_span(F.col("text"), one["start"], one["end"], F.col("lang")).alias("one"), T.delete_spans(F.col("text"), F.col("spans"), F.col("lang")).alias("all")).orderBy("i").collect()
    for (lang, text, spans), row in zip(cases, got):
        assert row.one == drop(text, *spans[0], lang)
        for span in sorted(spans, reverse=True):
            text = drop(text, *span, lang)
        assert row.all == text


def test_failures_have_reasons(spark):
    sentences = spark.createDataFrame([(i, "EN") for i in range(3)], "triplet_row_index bigint, sentence_language string")
    meta = spark.createDataFrame(
        [(0, "EN", "one two", True, [(0, 0), (0, 3)]), (1, "EN", "x", False, [])],
        "triplet_row_index bigint, sentence_language string, text string, has_offset_mapping boolean, char_offsets array<struct<start:int,end:int>>",
    )
    ok, bad = words.sentence_candidates(sentences, meta, ["triplet_row_index", "sentence_language"])
    assert [(r.word_text, r.n_subwords_deleted) for r in ok.collect()] == [("one", 1)]
    assert {(r.triplet_row_index, r.word_text, r.failure_reason) for r in bad.collect()} == {
        (0, "two", "offset_mapping_failed"), (1, "", "offset_mapping_failed"), (2, "", "missing_token_metadata"),
    }


def test_subset_joins_on_cast_keys(spark):
    triplets = spark.createDataFrame([(f"{100 + i}", i, 1 + i // 3, f"t{i}") for i in range(5)], "triplet_id string, triplet_row_index int, canonical_run int, en_text string")
    subset = words.token_subset(triplets, 2, "s", ("EN", "FR"))
    assert sorted((r.canonical_run, r.token_subset_rank) for r in subset.where("target_language = 'EN'").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    joined = words.subset_triplets(triplets.withColumn("triplet_id", F.col("triplet_id").cast("bigint")), subset)
    assert joined.where("en_text IS NULL").count() == 0 and joined.count() == 8
    assert [r.canonical_run for r in words.underfilled_runs(triplets, 3).collect()] == [2]
    assert words.fill_row_index(spark.createDataFrame([("101",), ("zzz",)], "triplet_id string"), triplets).count() == 1


@pytest.mark.parametrize("value,want", [("Hello, World!", "hello_world"), ("--", "na"), ("a__b", "a_b"), ("  ", "na"), ("É1", "1")])
def test_slug(spark, value, want):
    assert spark.range(1).select(T.slug(F.lit(value)).alias("s")).first().s == want


def test_token_json(spark):
    df = spark.createDataFrame([('["a", "b"]', "[[0, 1], [1, 3]]")], "token_strings_json string, char_offsets_json string")
    got = words.parse_token_json(df).first()
    assert got.token_strings == ["a", "b"] and [tuple(s) for s in got.char_offsets] == [(0, 1), (1, 3)]
