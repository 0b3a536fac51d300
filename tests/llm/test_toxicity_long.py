import numpy as np
import pytest

from tests.llm.helpers import prose
from tests.llm.test_classifiers import labelled
from voxelweave.llm import toxicity


@pytest.fixture(scope="module")
def model():
    texts, y = zip(*labelled(200))
    return toxicity.train(list(texts), np.array(y, float), bits=14, rounds=5, worst_rounds=10)


def whole(model, text):
    g = toxicity.grams([text.encode()], model.bits)
    return toxicity.worst_bags(toxicity.bag_means(model.weight, g), g)[1][0]


@pytest.mark.parametrize("at_once", [1, 7, 64, 1000, 1 << 20])
def test_pieces_leave_the_score(model, at_once):
    bad = next(t for t, y in labelled(200) if y)
    for text in [prose("long", 300), "Ünïcode — 漢字 " * 9, "again again again  " * 20 + bad, "x" * 500, "  lead " + bad + " " * 70, "a", ""]:
        got = toxicity.long_score(model.weight, text.encode(), model.bits, at_once)
        want = whole(model, text) if text else -np.inf
        assert got == pytest.approx(want, abs=1e-6)


def test_a_long_text_scores_as_a_whole(model):
    bad = next(t for t, y in labelled(200) if y)
    clean = prose("clean", 300_000)
    assert len(clean) > 2 << 20
    cut = clean[: (2 << 20) + 300]  # pieces of 1 MiB would leave a last one of little over 1 KiB
    text = cut[: cut.rindex(" ")] + " " + bad
    want = 1 / (1 + np.exp(-(model.slope * whole(model, text) + model.offset)))
    assert model.score([text, "one"])[0] == pytest.approx(want, abs=1e-6)
