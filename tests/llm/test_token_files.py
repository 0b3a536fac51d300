import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents, frame, prose
from voxelweave.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = [
    "", "a", " a", "a ", "\n\n a  b\n", "  lead and   gaps   between\n\n\nlines \n", "it's we'll 12 345,67 ... !!", "tab\there", "über 漢字 naïve x", "a b c",
    "x<|endoftext|>y z", "l'été déjà\r\nvu", "emoji 😀 ok", "​zero width", prose(1, 3000), "THE!! ÈÇÉ!! of%%% *** ### && $$$", "\x00 nul \x1f x", "a\u0085 b",
]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_chunks_give_the_tokenizer_s_ids(tokenizer, piece):
    coder = tf.ChunkEncoder(PATH, kept=40)
    rng = random.Random(2)
    alphabet = list("ab'  \n\n.,1é漢!*-") + ["the", " the", "'s", "x.'", "'.", "ª", "×"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(coder.encode(text, piece), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("lengths", [[1], [1] * 1000, [5, 100_000, 1, 1], [0, 0, 3, 0], list(np.random.default_rng(0).integers(1, 3000, 2000))])
def test_boundaries(lengths):
    ends = np.cumsum(lengths)
    data = tf.pack(list(range(len(lengths))), [np.zeros(n, "<u4").tobytes() for n in lengths], 2)
    boundaries, doc_ids, nulls, ids = tf.unpack(data)
    assert [boundaries.end(i) for i in range(len(ends))] == ends.tolist()
    assert np.concatenate(list(boundaries.ends(block=7))).tolist() == ends.tolist()
    assert doc_ids.tolist() == list(range(len(lengths))) and nulls == 0 and len(ids) == ends[-1]
    if len(ends) == 2000:
        assert len(boundaries.upper) + len(boundaries.lower) + 4 * len(boundaries.samples) < 2000 * (2.3 + np.log2(ends[-1] / 2000)) / 8
    with pytest.raises(IndexError):
        boundaries.end(len(ends))


@pytest.mark.parametrize("file_bytes", [400, 8 << 20])
def test_round_trip(spark, tokenizer, file_bytes):
    rows = awkward() + [(-3, "before all"), (11, "x<|endoftext|>y")]
    got = frame(tf.token_index(documents(spark, rows, part=1, path="p", ids=2), PATH, file_bytes=file_bytes))
    want, start = [], 0
    plain = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    got_rows = sorted(((None if r.doc_id != r.doc_id else int(r.doc_id)), r.n_tokens, r.ids_crc32) for r in got.itertuples() if r.doc_id == r.doc_id)
    want = sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in plain if d is not None)
    assert got_rows == want and len(got) == len(rows) and got.doc_id.isna().sum() == 2
    ordered = got.sort_values("start").reset_index(drop=True)
    assert ordered.doc_id.isna().tolist()[:2] == [True, True] and ordered.doc_id[2:].is_monotonic_increasing
    for row in ordered.itertuples():
        assert row.start == start
        start += row.n_tokens


def test_empty_table(spark):
    assert tf.token_index(documents(spark, []), PATH).count() == 0


def test_rewritten_files_are_the_same(spark):
    df = documents(spark, awkward())
    folder, manifest = tf.write(df, PATH, file_bytes=400)
    again, _ = tf.write(df, PATH, folder=folder, file_bytes=400)
    assert again == folder and tf.read(folder, manifest).count() == len(awkward())
