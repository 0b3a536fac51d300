import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents, frame, prose
from voxelweave.llm import compression_quality as cq, toxicity as tx

BAD = ["grumblax", "grumblaxes", "snorvik", "snorviks"]


def labelled(n, seed=1, words=60):
    """Texts, a tenth with bad words; the same endings never occur twice in training and test."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = prose(f"{seed}-{i}", rng.randrange(5, words)).split()
        y = int(i % 5 == 0)
        if y:
            for _ in range(1 + len(text) // 30):
                text.insert(rng.randrange(len(text)), rng.choice(BAD)[:6] + "".join(rng.choice("aeiouy") for _ in range(3)))
        rows.append((" ".join(text), y))
    return rows


def auc(scores, y):
    order = np.argsort(np.argsort(scores)) + 1
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_misspellings_unseen_in_training_are_found():
    learn, judge = labelled(400, 1), labelled(300, 2)
    model = tx.train([t for t, _ in learn], np.array([y for _, y in learn]), bits=14)
    assert auc(model.score([t for t, _ in judge]), [y for _, y in judge]) > 0.97
    plain = prose("long", 4000)
    assert model.score([plain])[0] < 0.2 < model.score([" ".join(f"{w} snorvika" if i % 40 == 0 else w for i, w in enumerate(plain.split()))])[0]


def slow_margin(model, text):
    """The same margin word by word."""
    words = text.encode().translate(tx.FOLD).split()
    halves, last = [], None
    for i, word in enumerate(words):
        if i % tx.HALF == 0:
            halves.append([])
        if word != last:
            marked = b" " + word + b" "
            for n in tx.GRAMS:
                for a in range(len(marked) - n + 1):
                    h = 0
                    for c in marked[a : a + n]:
                        h = (h * 0x01000193 + c) & 0xFFFFFFFF
                    halves[-1].append(model.weight[(((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - model.bits)])
        last = word
    bags = [halves[i] + (halves[i + 1] if i + 1 < len(halves) else []) for i in range(len(halves))]
    means = sorted((np.mean(b) if b else 0.0 for b in bags), reverse=True)
    return np.mean(means[: -(-len(means) // tx.WORST_SHARE)])


def test_blockwise_scores_equal_word_by_word_scores():
    rng = np.random.default_rng(0)
    model = tx.Model(10, np.append(rng.normal(size=1024), 0).astype(np.float32), 1.0, 0.0, 0.25)
    texts = ["one", "a b", "Same same same word", prose(1, 7), prose(2, 400), "ÉTÉ déjà — x", "x!y?z"]
    got = model.score(texts + ["", None, " \n"])
    want = [1 / (1 + np.exp(-slow_margin(model, t))) for t in texts] + [0.25] * 3
    np.testing.assert_allclose(got, want, atol=1e-5)
    assert model.score([None]).tolist() == model.score(["", "!"]).tolist()[:1] == [0.25]
    assert tx.train(["", "?"] * 10, np.arange(20) % 2, bits=10).score(["word"])[0] == 0.5
    np.testing.assert_allclose(model.score(texts[::-1]), got[: len(texts)][::-1], atol=1e-6)


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0]])
def test_one_class_gives_its_rate(labels):
    texts = [prose(i, 20) for i in range(len(labels))]
    for model in (tx.train(texts, np.array(labels), bits=10), cq.train(texts, np.array(labels))):
        found = model.score(["anything", None, ""])
        assert np.allclose(found, found[0]) and np.all((found > 0) & (found < 1))


def test_compression_tells_styles_apart():
    rng = random.Random(3)
    def row(i):
        text = prose(f"q{i}", rng.randrange(30, 90))
        return (" ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split()), 0) if i % 3 == 0 else (text, 1)
    learn, judge = [row(i) for i in range(300)], [row(1000 + i) for i in range(150)]
    model = cq.train([t for t, _ in learn], np.array([y for _, y in learn]), size=16_384)
    assert auc(model.score([t for t, _ in judge]), [y for _, y in judge]) > 0.97
    assert model.score(["", None]).tolist() == [model.empty] * 2


@pytest.mark.parametrize("module,label", [(tx, "toxic"), (cq, "quality")])
def test_scores_of_awkward_rows(spark, module, label):
    texts = labelled(60)
    rows = [(100 + i, t) for i, (t, _) in enumerate(texts)] + awkward()
    df = documents(spark, rows, score=0.5, label=3, predicted="x")
    labels = spark.createDataFrame([(100 + i, int(y), int(y)) for i, (_, y) in enumerate(texts)] + [(None, 1, 1), (100, None, None), (999_999, 0, 0), (101, 0, 0)], "doc_id long, toxic int, quality int")
    model = module.fit(df, labels)
    got = frame(module.scores(df, model))
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    for row in got[got.doc_id.notna()].itertuples():
        assert row.held_out == (zlib.crc32(str(int(row.doc_id)).encode()) % 3 == 1)
    by_text = {}
    for row in got.itertuples():
        by_text.setdefault(row.doc_id, set()).add(row.score)
    assert len(by_text[5.0]) == 1 and by_text[4.0] == by_text[5.0] and by_text[1.0] == by_text[2.0] == {model.empty}
    assert module.scores(documents(spark, []), model).count() == 0


def test_labels_of_the_held_fold_are_not_learned(spark):
    df = documents(spark, [(i, prose(i, 20)) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, toxic int")
    texts, y = tx.labelled_sample(df, labels, "toxic", 1000, 8000)
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    assert len(tx.labelled_sample(df, labels, "toxic", 20, 8000)[0]) == 20


def test_without_toxic_keeps_columns(spark):
    texts = labelled(500)
    df = documents(spark, [(i, t) for i, (t, _) in enumerate(texts)] + [(None, None)], score=1)
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    kept = tx.without_toxic(df, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and None in ids
    assert len([i for i, (_, y) in enumerate(texts) if y and i in ids]) < 50 and len([i for i, (_, y) in enumerate(texts) if not y and i in ids]) > 390


def test_model_needs_no_state_in_tasks(spark):
    import pickle

    model = cq.train([prose(i, 50) for i in range(20)], np.arange(20) % 2)
    first = model.score(["some text here"])
    assert pickle.loads(pickle.dumps(model)).score(["some text here"]) == first
