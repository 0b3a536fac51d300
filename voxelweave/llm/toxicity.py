"""Toxicity by subword-bag embeddings.

A text is cut into half-bags of ``HALF`` words; two neighbouring half-bags are a bag. A bag's vector is the average of the
embeddings of its words' character n-grams (UTF-8 bytes, word ends included, hashed into buckets), and a linear softmax over
it gives the bag's class. A misspelling shares n-grams with the word it stands for. Of a word that is repeated at once only
the first counts. A text is as toxic as the worst sixteenth of its bags (one at least): averages over whole texts would let
length wash out a few words, and the single worst bag would let length alone find something.

Embeddings and softmax are trained jointly with numpy on the driver, on a bounded sample of labelled rows (``sample_rows``
rows of at most ``train_chars`` characters): first with all bags of a text, then with its worst bags only (multiple-instance
learning). The last layer is linear, so scoring needs one number per bucket: the model that tasks get is one float array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelweave.llm.common import fold

GRAMS = (3, 4, 5, 6)
HALF = 4
WORST_SHARE = 16
BLOCK_BYTES = 1 << 20
#: Lower-case A-Z; other ASCII but letters and digits ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Grams:
    """N-grams of a run of texts. ids[n, i]: bucket of the n-gram at byte i, or the spare last bucket."""

    ids: np.ndarray
    half_starts: np.ndarray
    half_text: np.ndarray
    texts: int


def gram_ids(joined: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each byte but the last max(GRAMS), one row for each length."""
    n = len(joined) - max(GRAMS)
    spaces = np.cumsum(joined == 32, dtype=np.int32)
    ids = np.empty((len(GRAMS), n), np.int32)
    rolling = joined[:n].astype(np.uint32)
    for k in range(1, max(GRAMS)):
        rolling = rolling * np.uint32(0x01000193) + joined[k : k + n]
        if k + 1 in GRAMS:
            bucket = ((rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            whole = spaces[k - 1 : k - 1 + n] == spaces[:n]  # no word end inside
            ids[GRAMS.index(k + 1)] = np.where(whole, bucket, 1 << bits)
    return ids


def grams(texts: list[bytes], bits: int) -> Grams:
    joined = np.frombuffer(b" " + b" ".join(t.translate(FOLD) for t in texts) + b" " * max(GRAMS), np.uint8)
    space = joined == 32
    ids = gram_ids(joined, bits)
    n = ids.shape[1]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # the space before the next text
    word_starts = np.flatnonzero(space[:-1] & ~space[1:])  # the space before a word
    word_text = np.searchsorted(ends, word_starts, side="right")
    first = np.searchsorted(word_text, np.arange(len(texts)))
    head = (np.arange(len(word_starts)) - first[word_text]) % HALF == 0
    if len(word_starts):
        inside = np.where(ids[0] < 1 << bits, ids[0], 0).astype(np.int64)
        sign = np.add.reduceat(inside, word_starts) * 31 + joined[word_starts + 1]
        again = np.append(False, (sign[1:] == sign[:-1]) & (word_text[1:] == word_text[:-1]))
        lengths = np.diff(np.append(word_starts, n))
        ids[:, word_starts[0] :][:, np.repeat(again, lengths)] = 1 << bits
    return Grams(ids, word_starts[head], word_text[head], len(texts))


def half_sums(values: np.ndarray, g: Grams) -> np.ndarray:
    """Sum over the half-bags of a value for each byte."""
    return np.add.reduceat(values, g.half_starts, dtype=float) if len(g.half_starts) else np.empty(0)


def bag_means(weight: np.ndarray, g: Grams) -> np.ndarray:
    """Mean bucket weight of the bag that begins with each half-bag; a text's last half-bag belongs to the one before too."""
    total, count = np.zeros(g.ids.shape[1], np.float32), np.zeros(g.ids.shape[1], np.float32)
    weight = weight.astype(np.float32, copy=False)
    for row in g.ids:
        total += weight[row]
        count += row < len(weight) - 1
    total, count = half_sums(total, g), half_sums(count, g)
    same = np.append(g.half_text[1:] == g.half_text[:-1], False)
    total[same] += total[np.flatnonzero(same) + 1]
    count[same] += count[np.flatnonzero(same) + 1]
    return total / np.maximum(count, 1)


def worst_bags(means: np.ndarray, g: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(share of each bag in its text's score, score of each text: the mean of its worst bags; -inf without words)."""
    bags = np.bincount(g.half_text, minlength=g.texts)
    order = np.lexsort((-means, g.half_text))
    rank = np.arange(len(order)) - (np.cumsum(bags) - bags)[g.half_text]
    take = -(-bags // WORST_SHARE)
    share = np.zeros(len(means))
    share[order] = (rank < take[g.half_text]) / np.maximum(take, 1)[g.half_text]
    return share, np.where(bags > 0, np.bincount(g.half_text, share * means, g.texts), -np.inf)


def long_score(weight: np.ndarray, data: bytes, bits: int, at_once: int) -> float:
    """The score of one text as by ``grams``, ``bag_means`` and ``worst_bags``, with n-grams of ``at_once`` bytes at a time.

    What is kept of the whole text are three numbers a word, so bags and the worst sixteenth are those of the whole text.
    """
    joined = np.frombuffer(b" " + data.translate(FOLD) + b" " * max(GRAMS), np.uint8)
    n = len(joined) - max(GRAMS)
    weight = weight.astype(np.float32, copy=False)
    sums: list[np.ndarray] = []  # of each stretch: (weight, n-grams, sum of buckets of the shortest n-grams) of its words
    signs: list[np.ndarray] = []
    carry, carry_sign = np.zeros(2), 0
    firsts = []
    for at in range(0, n, at_once):
        part = joined[at : min(at + at_once, n) + max(GRAMS)]
        ids = gram_ids(part, bits)
        size = ids.shape[1]
        starts = np.flatnonzero((part[:size] == 32) & (part[1 : size + 1] != 32))
        total, count = np.zeros(size, np.float32), np.zeros(size, np.float32)
        for row in ids:
            total += weight[row]
            count += row < len(weight) - 1
        inside = np.where(ids[0] < 1 << bits, ids[0], 0).astype(np.int64)
        bounds = np.append(0, starts)
        own = np.stack([np.add.reduceat(v, bounds, dtype=float) for v in (total, count)])
        sign = np.add.reduceat(inside, bounds)
        if len(starts) and starts[0] == 0:  # reduceat of an empty stretch gives its first value
            own[:, 0], sign[0] = 0, 0
        own[:, 0] += carry  # the stretch before the first start belongs to the word that began earlier
        sign[0] += carry_sign
        carry, carry_sign = own[:, -1], sign[-1]
        sums.append(own[:, :-1])
        signs.append(sign[:-1])
        firsts.append(part[starts + 1])
    total, count = np.concatenate([*sums, carry[:, None]], axis=1)[:, 1:]  # what comes before the first word holds nothing
    if not len(total):
        return -np.inf
    sign = np.append(np.concatenate(signs), carry_sign)[1:] * 31 + np.concatenate(firsts)
    again = np.append(False, sign[1:] == sign[:-1])
    total[again] = count[again] = 0
    heads = np.arange(0, len(total), HALF)
    total, count = np.add.reduceat(total, heads), np.add.reduceat(count, heads)
    total, count = total + np.append(total[1:], 0), count + np.append(count[1:], 0)
    means = np.sort(total / np.maximum(count, 1))
    return float(means[-(-(-len(means) // WORST_SHARE)) :].mean())


@dataclass
class Model:
    bits: int
    weight: np.ndarray  # softmax margin of each bucket's embedding; 0 for the spare one
    slope: float
    offset: float
    empty: float  # score of texts without words

    def score(self, texts: list[str | None]) -> np.ndarray:
        margins = np.full(len(texts), -np.inf)
        block: list[tuple[int, bytes]] = []
        for number, text in enumerate(texts):
            data = (text or "").encode()
            if len(data) > BLOCK_BYTES:
                margins[number] = long_score(self.weight, data, self.bits, BLOCK_BYTES)
                continue
            block.append((number, data))
            if sum(len(x) for _, x in block) >= BLOCK_BYTES:
                self._score(block, margins)
                block = []
        self._score(block, margins)
        known = np.isfinite(margins)
        score = 1 / (1 + np.exp(-(self.slope * np.where(known, margins, 0) + self.offset)))
        return np.where(known, np.round(score, 9), self.empty)  # sums of one text differ in their last bits by its place in a block

    def _score(self, block: list[tuple[int, bytes]], margins: np.ndarray) -> None:
        if block:
            g = grams([x for _, x in block], self.bits)
            if not len(g.half_starts):  # no words at all
                return
            margins[[n for n, _ in block]] = worst_bags(bag_means(self.weight, g), g)[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], labels: np.ndarray, bits: int = 18, width: int = 8, rounds: int = 15, worst_rounds: int = 45, rate: float = 3.0, seed: int = 42) -> Model:
    """Embeddings (2**bits x width) and a two-class softmax by full-batch AdaGrad; a fifth of the rows only calibrates.

    The gradient of a bucket's embedding is the softmax difference times a scalar, the summed error of the bags it is in,
    so a round is one weighted count over all n-grams.
    """
    labels = np.asarray(labels, float)
    prior = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if len(set(labels)) < 2:
        return Model(bits, np.zeros((1 << bits) + 1, np.float32), 1.0, float(np.log(prior / (1 - prior))), prior)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2 or labels[held].sum() < 5:
        held = np.zeros(len(texts), bool)
    g = grams([t.encode() for t, h in zip(texts, held) if not h], bits)
    y = labels[~held]
    if not len(g.half_starts):
        return Model(bits, np.zeros((1 << bits) + 1, np.float32), 1.0, float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, ((1 << bits) + 1, width))
    softmax = rng.normal(0, 0.1, (2, width))
    table[-1] = 0
    seen_table, seen_softmax = np.full((1 << bits) + 1, 1e-8), np.full(width, 1e-8)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    counts = half_sums(sum((row < 1 << bits).astype(np.float32) for row in g.ids), g)
    same = np.append(g.half_text[1:] == g.half_text[:-1], False)
    nxt = np.flatnonzero(same) + 1
    size = counts.copy()
    size[same] += counts[nxt]
    bags = np.bincount(g.half_text, minlength=g.texts)
    lengths = np.diff(np.append(g.half_starts, g.ids.shape[1]))
    bias = 0.0
    for step in range(rounds + worst_rounds):
        margin = softmax[1] - softmax[0]
        means = bag_means(table @ margin, g)
        if step < rounds:
            share = 1.0 / bags[g.half_text]
        else:
            share, _ = worst_bags(means, g)
        error = (_sigmoid(means + bias) - y[g.half_text]) * balance[g.half_text] * share
        per_half = error / np.maximum(size, 1)
        per_half[nxt] += (error / np.maximum(size, 1))[same]  # a bag is its half-bag and the next
        per_byte = np.zeros(g.ids.shape[1])
        per_byte[g.half_starts[0] :] = np.repeat(per_half, lengths)
        pull = sum(np.bincount(row, per_byte, (1 << bits) + 1) for row in g.ids)
        pull[-1] = 0
        move = pull @ table
        seen_table += pull**2 * (margin @ margin)
        seen_softmax += move**2
        table -= rate * (pull / np.sqrt(seen_table))[:, None] * margin[None, :]
        delta = 0.1 * rate * move / np.sqrt(seen_softmax)
        softmax[1] -= delta / 2
        softmax[0] += delta / 2
        bias -= rate * error.sum()
    model = Model(bits, (table @ (softmax[1] - softmax[0])).astype(np.float32), 1.0, bias, prior)
    judge = held if held.any() else ~held
    margins = _margins(model, [t for t, h in zip(texts, judge) if h])
    model.slope, model.offset = calibrate(margins, labels[judge])
    return model


def _margins(model: Model, texts: list[str]) -> np.ndarray:
    p = np.clip(Model(model.bits, model.weight, 1.0, 0.0, 0.5).score(texts), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic fit (Newton), on standardised x for stable steps."""
    mean, spread = x.mean(), x.std() + 1e-9
    rows = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1)
    target = (y * y.sum() + y * 1.0) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2)  # Platt's targets keep it finite
    w = np.zeros(2)
    for _ in range(steps):
        p = _sigmoid(rows @ w)
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge / len(x) * np.eye(2) + 1e-9 * np.eye(2), rows.T @ (p - target))
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample_rows: int, train_chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``sample_rows`` labelled texts of the learning folds, half of them at most of either class, in the order of a
    hash of the id. Texts over ``train_chars`` characters are not learned from (they are scored whole)."""
    known = labels.where(F.col(label).isNotNull() & (fold("doc_id") != 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for k in (0, 1)]
    found = (
        documents.where(F.length("text") <= train_chars).select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    )
    return found["text"].tolist(), found["label"].to_numpy(float)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 4_000, train_chars: int = 6_000, **how) -> Model:
    """Model from a bounded sample of the labelled rows whose fold is not 1, calibrated to the rate of label 1 among all of them."""
    texts, y = labelled_sample(documents, labels, label, sample_rows, train_chars)
    model = train(texts, y, **how)
    counts = {r["label"]: r["n"] for r in labels.where(fold("doc_id") != 1).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    if counts.get(0) and counts.get(1) and 0 < y.mean() < 1:  # from the sample's share of label 1 to that of all labels
        model.offset += float(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
        model.empty = counts[1] / (counts[0] + counts[1])
    return model


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that only a slice's texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scores(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``documents``, in one pass without a shuffle.

    Only doc_id and text are read, so further columns may have any name. Texts that are null, empty or without words get the
    rate of label 1 among all labels. Equal texts get equal scores. A null doc_id keeps its row with held_out false. An empty
    table gives no rows; without both labels the score is that rate for every text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """``documents`` without those the model calls toxic; columns and texts stay, and a row is judged by its own text."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.score(batch.column("text").to_pylist())
            yield batch.filter(pa.array(found < threshold))

    return documents.mapInArrow(run, documents.schema)
