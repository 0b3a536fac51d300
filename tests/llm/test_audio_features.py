import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, frame
from voxelweave.llm import audio_features as af


@pytest.mark.parametrize("rate,target", [(16000, 8000), (8000, 16000), (12000, 8000), (8000, 8000)])
def test_resampling_is_a_filter_on_the_raised_grid(rate, target):
    x = np.random.default_rng(1).normal(size=301).astype(np.float32)
    divisor = np.gcd(rate, target)
    up, down = target // divisor, rate // divisor
    if up == down:
        want = x
    else:
        raised = np.zeros(len(x) * up)
        raised[::up] = x
        taps = af.low_pass(up, down)
        want = np.convolve(raised, taps)[len(taps) // 2 :][: len(raised)][::down]
    got = af.resample(x, rate, target)
    assert len(got) == -(-len(x) * up // down)
    np.testing.assert_allclose(got, want[: len(got)], atol=1e-5)


def test_tone_falls_into_its_band():
    t = np.arange(8000) / 8000
    mels, db = af.log_mel(np.sin(2 * np.pi * 1000 * t).astype(np.float32))
    centres = np.argmax(af.mel_filters(8000), axis=0) * 8000 / af.FFT
    assert abs(centres[np.argmax(mels.mean(axis=0))] - 1000) < 80
    assert len(mels) == len(db) == 1 + -(-(8000 - af.FRAME) // af.HOP)


def test_blocks_do_not_change_frames(monkeypatch):
    x = np.random.default_rng(2).normal(size=20_000).astype(np.float32)
    whole = af.log_mel(x)[0]
    monkeypatch.setattr(af, "BLOCK", 64)
    np.testing.assert_allclose(af.log_mel(x)[0], whole, atol=1e-4)


def test_hysteresis():
    db = np.array([0, 0, 2, 5, 2, 2, 0, 2, 2, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], float)
    on = af.active(db)
    assert np.flatnonzero(on).tolist() == [3, 4, 5, 9]
    assert af.segments(on) == [(30, 75), (90, 115)]


def test_wav_round_trip_and_tensors(spark):
    rows = awkward()
    found = frame(af.document_audio(documents(spark, rows, media="m", clips=1)))
    assert len(found) == len(rows)
    by_size = {}
    for _, text in rows:
        data = (text or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        by_size[hashlib.sha256(padded).hexdigest()] = (len(data), padded)
    for row in found.itertuples():
        n, padded = by_size[row.payload_sha256]
        media = af.to_wav(padded)
        assert (row.n_bytes == n or n in (0, 5)) and row.payload_bytes == len(padded) and row.tail_crc32 == zlib.crc32(padded[-32:])
        assert row.media_bytes == len(media) and row.media_sha256 == hashlib.sha256(media).hexdigest() and af.from_wav(media) == (af.RATE, padded)
        table = pa.ipc.open_stream(row.clips).read_all()
        tensor = table["log_mel"].combine_chunks()
        assert tensor.type == pa.fixed_shape_tensor(pa.float16(), (af.CLIP, af.MELS))
        assert len(table) == -(-row.n_frames // af.CLIP) and table["from_ms"].to_pylist()[0] == 0
    assert found.groupby("payload_sha256").clips.nunique().max() == 1
    assert af.document_audio(documents(spark, [])).count() == 0


def test_digest_of_equal_texts(spark):
    got = frame(af.digest(af.document_audio(documents(spark, awkward()))))
    assert got.groupby("payload_sha256").feature.nunique().max() == 1 and got.feature.nunique() > 4
