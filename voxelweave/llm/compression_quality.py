"""Quality by compression: which of two zstandard dictionaries, built from good and from bad labelled text, fits a text better.

A text is cut into pieces of ``PIECE`` bytes, so that long texts cannot become their own dictionary; every piece is compressed
once with either dictionary. The difference of the two sizes over the size of the text is a margin, and a logistic fit on
labelled rows that built no dictionary makes it a probability. (Over the sum of both sizes, repetitive text, which either
dictionary makes tiny, would look as decided as any other.) Dictionaries and fit come from a bounded sample
(``sample_rows`` rows of at most ``train_chars`` characters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from voxelweave.llm.common import fold
from voxelweave.llm.toxicity import calibrate, labelled_sample, slices

PIECE = 512
LEVEL = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    empty: float  # score of texts without bytes
    ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "ready": []}

    def margin(self, text: str | None) -> float | None:
        """(size with the bad dictionary - size with the good one) / bytes of the text; None for no bytes."""
        if not self.ready:
            for raw in (self.good, self.bad):
                content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=LEVEL)
                self.ready.append(zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        data = (text or "").encode()
        if not data:
            return None
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.ready)
        return (bad - good) / len(data)

    def score(self, texts: list[str | None]) -> np.ndarray:
        margins = [self.margin(t) for t in texts]
        return np.array([self.empty if m is None else 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))) for m in margins], float)


def dictionary(texts: list[str], size: int) -> bytes:
    """Content of a zstandard dictionary: the trained one's selection, or the texts themselves where there are too few to train."""
    pieces = [p for t in texts if (d := t.encode()) for p in (d[i : i + PIECE] for i in range(0, len(d), PIECE))]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def train(texts: list[str], labels: np.ndarray, size: int = 262_144) -> Model:
    labels = np.asarray(labels, float)
    prior = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    plain = Model(b" ", b" ", 0.0, float(np.log(prior / (1 - prior))), prior)
    if len(set(labels)) < 2:
        return plain
    held = np.arange(len(texts)) % 2 == 1  # half builds dictionaries, half calibrates
    if min(labels[held].sum(), (1 - labels[held]).sum(), labels[~held].sum(), (1 - labels[~held]).sum()) < 1:
        held = np.zeros(len(texts), bool)
    own = lambda k: [t for t, y, h in zip(texts, labels, held) if y == k and not h]
    model = Model(dictionary(own(1), size) or b" ", dictionary(own(0), size) or b" ", 1.0, 0.0, prior)
    judge = held if held.any() else ~held
    pairs = [(m, y) for t, y, j in zip(texts, labels, judge) if j and (m := model.margin(t)) is not None]
    if len({y for _, y in pairs}) < 2:
        return plain
    model.slope, model.offset = calibrate(np.array([m for m, _ in pairs]), np.array([y for _, y in pairs]))
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4_000, train_chars: int = 8_000, size: int = 262_144) -> Model:
    """Model from a bounded sample of the labelled rows whose fold is not 1, calibrated to the rate of label 1 among all of them."""
    texts, y = labelled_sample(documents, labels, label, sample_rows, train_chars)
    model = train(texts, y, size)
    counts = {r["label"]: r["n"] for r in labels.where(fold("doc_id") != 1).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    if counts.get(0) and counts.get(1) and 0 < y.mean() < 1:
        model.offset += float(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
        model.empty = counts[1] / (counts[0] + counts[1])
    return model


def scores(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``documents``, in one pass without a shuffle.

    Only doc_id and text are read, so further columns may have any name. Null and empty texts get the rate of label 1 among
    all labels. Equal texts get equal scores. A null doc_id keeps its row with held_out false. An empty table gives no rows;
    without both labels the score is that rate for every text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
