import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents, frame, prose
from voxelweave.llm import mixing


def fill(sizes, weights, share, epochs):
    """Targets by repeated sharing out of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = want - sum(capped.values())
        over = {s: epochs * sizes[s] for s in rest if left * w[s] / sum(w[x] for x in rest) >= epochs * sizes[s]}
        if not over:
            return capped | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        capped |= over
        if len(capped) == len(names):
            return capped


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, "d": 7, None: 300}, {"a": 1}, {"a": 0, "b": 5}, {"Z": 40, "a": 1, "é": 60}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix_comes_near_targets_and_repeats(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", "big" if i % 3 else f"s{i % 4}", 0) for i in range(600)] + [(d if d is None else 1000 + d, t, "en", None, 0) for d, t in awkward()]
    df = documents(spark, rows, size=9, key=1, part=2, target=3)
    got = frame(mixing.mix(df))
    assert len(got) == len(rows)
    largest = got.groupby("source", dropna=False)["size"].max()
    for source, part in got.groupby("source", dropna=False):
        taken = part[part["size"] > 0]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= largest[source] / 2 + 1e-6
        times = taken.taken / taken["size"]
        assert times.max() <= 2 and times.max() - times.min() <= 1  # complete epochs precede the sample
        assert part.source_size.iloc[0] == part["size"].sum()
    assert got[got.doc_id == 1001]["size"].tolist() == [0]
    again = frame(mixing.mix(df.repartition(7)))
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_heavier_documents_are_taken_more_often(spark):
    df = documents(spark, [(i, ("same " * 20 if i % 2 else prose(i, 20)), "en", "s", 0) for i in range(2000)])
    got = frame(mixing.mix(df, weights=(1,), share=0.3))
    taken = got[got.taken > 0]
    assert (taken.doc_id % 2 == 0).mean() > 0.9


def test_mixed_repeats_rows(spark):
    df = documents(spark, [(i, prose(i, 10), "en", f"s{i % 3}", 0) for i in range(60)] + [(None, "a b", "en", "s1", 0), (99, "", "en", "s1", 0)], mix_extra=1)
    found = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.size}
    kept = mixing.mixed(df)
    assert kept.columns == df.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in found.items() if n and d is not None} | {None: 1, 99: 1}


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_words_are_split_at_ascii_white_space_only(spark):
    df = documents(spark, [(1, "a\u00a0b c\x0bd\x1fe"), (2, " x "), (3, "\n")])
    assert [r.n for r in df.select(F.size(mixing.words(F.col("text"))).alias("n"), "doc_id").orderBy("doc_id").collect()] == [3, 1, 0]
