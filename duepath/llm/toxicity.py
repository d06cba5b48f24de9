"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed into ``BUCKETS``), a window of ``WINDOW`` words
the mean of its words, and a linear softmax over it says toxic or not; embeddings and softmax are trained jointly. A
document is as toxic as its worst window, so a few words in a long text are not averaged away; in training too, the
gradient of a document goes through its worst window. Misspellings never seen share n-grams with words that were.

The model is fitted on a bounded sample of labelled rows: of either label the ``SAMPLE_DOCS`` with the smallest hash of
doc_id among texts of at most ``SAMPLE_CHARS`` characters, whole. Every text is scored whole.

Defined cases: null text, empty text and text without words get the score of a window without evidence; without rows of
both labels every score is 0; of contradicting labels of one doc_id toxic holds; empty tables give no rows; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.llm import text as tx
from duepath.llm.rows import few_of_each
from duepath.session import cut_lineage

SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 3_000
BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
WINDOW, STRIDE = 16, 8
EPOCHS, RATE, DECAY = 40, 0.3, 1e-5
THRESHOLD = 0.7

_WORD = tx.table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b"'")


def _unique_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words, the place of each word among them, and word bounds by row."""
    starts, ends, bounds = tx.words(raw, offsets, _WORD[raw])
    hashes = tx.word_hashes(raw, starts, ends)
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return starts[first], ends[first], place, bounds


def grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of <word>, of all sizes, and their bounds by word."""
    size = ends - starts + 2
    room = np.concatenate([[0], np.cumsum(size)])
    padded = np.empty(int(room[-1]), np.uint8)
    inner = np.ones(len(padded), bool)
    inner[room[:-1]] = inner[room[1:] - 1] = False
    padded[room[:-1]], padded[room[1:] - 1] = 60, 62
    at = np.arange(len(padded)) - np.repeat(room[:-1] + 1, size) + np.repeat(starts, size)
    padded[inner] = raw[at[inner]]
    word = np.repeat(np.arange(len(starts)), size)
    end = np.repeat(room[1:], size)
    place = np.arange(len(padded))
    found, owner = [], []
    value = np.zeros(len(padded), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = tx.mix(value + padded[np.minimum(place + n - 1, len(padded) - 1)].astype(np.uint64) * tx.BASE)
        if n in GRAMS:
            fits = place + n <= end
            found.append(value[fits] % np.uint64(BUCKETS))
            owner.append(word[fits])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(starts) + 1))


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends of all windows and their bounds by row; the last window of a row ends with the row."""
    counts = np.diff(bounds)
    n = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    to = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(counts)), n)
    start = bounds[row] + (np.arange(to[-1]) - to[row]) * STRIDE
    return start, np.minimum(start + WINDOW, bounds[row + 1]), to


def first_in_window(place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 for a word that its row doesn't have among the ``WINDOW`` words before, else 0: echoes count once."""
    order = np.argsort(place, kind="stable")
    before = np.full(len(place), -1)
    same = place[order[1:]] == place[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(place))
    return ((before < begin) | (at - before > WINDOW)).astype(float)


@dataclass
class Model:
    """Margin per bucket (embeddings times softmax weights), bias, and scale and shift to a probability."""

    margins: np.ndarray
    bias: float
    scale: float
    shift: float

    def document_margins(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), -1e9)
        for first, raw, offsets in tx.slices(column):
            raw = tx.lower_ascii(raw)
            starts, ends, place, bounds = _unique_words(raw, offsets)
            if not len(place):
                continue
            bucket, to = grams(raw, starts, ends)
            word = np.add.reduceat(self.margins[bucket], to[:-1]) / np.diff(to)
            sums = np.concatenate([[0.0], np.cumsum(word[place] * first_in_window(place, bounds))])
            start, end, rows = windows(bounds)
            value = (sums[end] - sums[start]) / np.maximum(end - start, WINDOW // 2)
            full = np.flatnonzero(np.diff(rows) > 0)
            out[first + full] = np.maximum.reduceat(value, rows[full])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = np.maximum(self.document_margins(column), -50.0 * abs(self.bias) - 50.0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * margin + self.shift, -40, 40)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Embeddings and softmax trained jointly by Adagrad; each document by the window that is worst at the time."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, -40.0)
    raw = tx.lower_ascii(np.frombuffer("".join(texts).encode(), np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    starts, ends, place, bounds = _unique_words(raw, offsets)
    bucket, to = grams(raw, starts, ends)
    start, end, rows = windows(bounds)
    full = np.flatnonzero(np.diff(rows) > 0)
    y = y[full]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    rng = np.random.Generator(np.random.PCG64(8))
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax = np.stack([-np.ones(DIM), np.ones(DIM)], 1) * 0.5 / np.sqrt(DIM)
    bias = np.zeros(2)
    seen = [np.full_like(p, 1e-8) for p in (embeddings, softmax, bias)]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(to))
    bucket = bucket.astype(np.int32)
    fresh = first_in_window(place, bounds)[:, None]
    for _ in range(EPOCHS):
        words = np.stack([np.bincount(owner, embeddings[bucket, k], len(starts)) for k in range(DIM)], 1) / np.diff(to)[:, None]
        sums = np.concatenate([np.zeros((1, DIM)), np.cumsum(words[place] * fresh, axis=0)])
        size = np.maximum(end - start, WINDOW // 2)[:, None]
        bag = (sums[end] - sums[start]) / size
        logit = bag @ softmax + bias
        margin = logit[:, 1] - logit[:, 0]
        # the worst window of each document
        top = np.maximum.reduceat(margin, rows[full])
        worst = np.flatnonzero(margin == np.repeat(top, np.diff(rows)[full]))
        of = np.searchsorted(rows, worst, "right") - 1
        keep = np.unique(of, return_index=True)[1]
        worst = worst[keep]
        p = np.exp(logit[worst] - logit[worst].max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - np.stack([1 - y, y], 1)) * weight[:, None]
        g_softmax, g_bias = bag[worst].T @ error, error.sum(0)
        g_bag = error @ softmax.T / size[worst]
        # windows of one document overlap no other's: spread the gradient over the words of each window
        length = end[worst] - start[worst]
        inside = np.repeat(start[worst], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at, g = place[inside], np.repeat(g_bag, length, axis=0) * fresh[inside]
        g_word = np.stack([np.bincount(at, g[:, k], len(starts)) for k in range(DIM)], 1) / np.diff(to)[:, None]
        g_embed = np.stack([np.bincount(bucket, g_word[owner, k], BUCKETS) for k in range(DIM)], 1) + DECAY * embeddings / BUCKETS
        for value, g, sq in zip((embeddings, softmax, bias), (g_embed, g_softmax, g_bias), seen):
            sq += g * g
            value -= RATE * g / np.sqrt(sq)
    weights = softmax[:, 1] - softmax[:, 0]
    model = Model(embeddings @ weights, float(bias[1] - bias[0]), 1.0, 0.0)
    # probability from margin: logistic curve on the training documents
    margin = model.document_margins(pa.array(texts, pa.string()))[full]
    a, b = 1.0 / max(margin.std(), 1e-9), -margin.mean() / max(margin.std(), 1e-9)
    x = np.stack([margin * a + b, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (q * (1 - q) + 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (weight * (q - y)) + 1e-4 * w)
    model.scale, model.shift = float(w[0] * a), float(w[0] * b + w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """A model from a bounded sample of the rows whose doc_id satisfies ``may_learn``."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(may_learn & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS)).join(marks, "doc_id")
    sample, _ = few_of_each(cut_lineage(rows, "labelled"), "toxic", SAMPLE_DOCS)
    sample = sorted(sample.collect(), key=lambda r: (r["toxic"], r["place"]))
    return fit([r["text"] for r in sample], [int(r["toxic"] == 1) for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, score double, predicted int")
