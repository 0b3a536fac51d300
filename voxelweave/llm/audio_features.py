"""Media columns: texts' bytes as 8-bit audio, stored as WAV, and features of it.

The payload (UTF-8, then bytes 255 up to a multiple of 576) is the sample data of a mono 8-bit WAV file, one binary per row of a
Parquet table. Features come from the bytes read back: polyphase resampling to ``TARGET`` Hz, overlapped log-mel filterbank
frames, and segments of speech-like energy with two thresholds (on above the upper, off below the lower). Frames are cut into
clips of one shape and stored as an Arrow stream with a fixed-shape tensor column and the clips' time spans.

Everything is computed per document and in blocks of frames, so equal texts give equal bytes whatever their neighbours,
and memory follows a block beside the document itself.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelweave.llm.common import stored

UNIT, FILL = 576, 255
RATE, TARGET = 16_000, 8_000
FRAME, HOP, FFT, MELS, CLIP = 200, 80, 256, 40, 32
BLOCK = 4_096
UPPER_DB, LOWER_DB = 3.0, 1.0


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those padded to a positive multiple of UNIT)."""
    data = (text or "").encode()
    return len(data), data + bytes([FILL]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return file.getframerate(), file.readframes(file.getnframes())


@functools.lru_cache(maxsize=8)
def low_pass(up: int, down: int, half: int = 15) -> np.ndarray:
    """Hann-windowed sinc at the lower of both rates' half, with gain ``up``."""
    n = half * max(up, down)
    t = np.arange(-n, n + 1)
    taps = np.sinc(t / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * t / (n + 1)))
    return (taps / taps.sum() * up).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase: each output sample takes the filter phase its position falls on; zeros are never multiplied."""
    divisor = np.gcd(rate, target)
    up, down = int(target // divisor), int(rate // divisor)
    if up == down:
        return x.astype(np.float32)
    taps = low_pass(up, down)
    middle = len(taps) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    pad = len(taps) // up + 1
    padded = np.concatenate([np.zeros(pad, np.float32), x.astype(np.float32), np.zeros(pad + down + 1, np.float32)])
    for first in range(min(up, n)):
        position = np.arange(first, n, up) * down + middle  # on the grid of the raised rate
        phase, newest = int(position[0] % up), int(position[0] // up)
        own, count, step = taps[phase::up], len(position), down
        total = np.zeros(count, np.float32)
        for k, tap in enumerate(own):
            begin = newest - k + pad
            piece = padded[max(0, begin) : begin + (count - 1) * step + 1 : step]
            total[: len(piece)] += tap * piece
        out[first::up] = total
    return out


@functools.lru_cache(maxsize=4)
def mel_filters(rate: int) -> np.ndarray:
    """Triangles on the mel scale, (FFT / 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, 1 / rate)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int = TARGET) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, dB of each frame); a last frame that is not full is padded with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    window, mels, power = np.hanning(FRAME).astype(np.float32), [], []
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        spectrum = np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, FFT)).astype(np.float32) ** 2
        mels.append(np.log(spectrum @ mel_filters(rate) + 1e-6))
        power.append(10 * np.log10(spectrum.mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(power)


def active(db: np.ndarray) -> np.ndarray:
    """Hysteresis: on above the noise floor plus UPPER_DB, off below it plus LOWER_DB, else as before."""
    floor = np.sort(db)[len(db) // 5]
    change = np.where(db > floor + UPPER_DB, 1, np.where(db < floor + LOWER_DB, 0, -1))
    last = np.maximum.accumulate(np.where(change >= 0, np.arange(len(db)), -1))
    return np.where(last >= 0, change[last], 0).astype(bool)


def segments(on: np.ndarray, rate: int = TARGET) -> list[tuple[int, int]]:
    """(from, to) in milliseconds of each run of active frames."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a * HOP * 1000 // rate), int(((b - 1) * HOP + FRAME) * 1000 // rate)) for a, b in zip(edge[::2], edge[1::2])]


def clip_tensors(mels: np.ndarray, on: np.ndarray, rate: int = TARGET) -> bytes:
    """An Arrow stream (from_ms, to_ms, active_frames, log_mel: fixed-shape tensor CLIP x MELS of half precision)."""
    n = -(-len(mels) // CLIP)
    full = np.zeros((n * CLIP, MELS), np.float16)
    full[: len(mels)] = mels
    flags = np.concatenate([on, np.zeros(n * CLIP - len(on), bool)]).reshape(n, CLIP).sum(axis=1)
    starts = np.arange(n) * CLIP
    ends = np.minimum(starts + CLIP, len(mels))
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, CLIP, MELS))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(starts * HOP * 1000 // rate, pa.int64()), pa.array(((ends - 1) * HOP + FRAME) * 1000 // rate, pa.int64()), pa.array(flags, pa.int32()), tensor],
        names=["from_ms", "to_ms", "active_frames", "log_mel"],
    )
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def media_table(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media: WAV bytes), written to the shared folder and read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = [payload(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in padded], pa.int64()), pa.array([to_wav(p) for _, p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return stored(documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "segments array<struct<from_ms: long, to_ms: long>>, n_frames long, clips binary"
)


def audio_features(media: DataFrame) -> DataFrame:
    """Rows of FEATURES from the stored media, one for each row and in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for item in batch.column(2):
                    data = item.as_py()
                    rate, samples = from_wav(data)
                    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
                    mels, db = log_mel(resample(x, rate, TARGET))
                    on = active(db)
                    rows.append((
                        len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                        [{"from_ms": a, "to_ms": b} for a, b in segments(on)], len(mels), clip_tensors(mels, on),
                    ))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), span, pa.int64(), pa.binary())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "n_frames", "clips"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def document_audio(documents: DataFrame) -> DataFrame:
    """Rows of FEATURES for each row of ``documents``.

    Null and empty texts are 576 bytes of 255. Only doc_id and text are read, so further columns may have any name. Repeated
    rows and null ids are kept; equal texts give equal values. An empty table gives no rows.
    """
    return audio_features(media_table(documents))


def digest(features: DataFrame) -> DataFrame:
    """FEATURES with segments and clips as one string: frames, active milliseconds, segments, hash of the tensor stream."""
    active_ms = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["to_ms"] - s["from_ms"])
    text = F.concat_ws(":", F.col("n_frames").cast("string"), active_ms.cast("string"), F.size("segments").cast("string"), F.sha2("clips", 256))
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"))
