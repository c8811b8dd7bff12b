"""Quality by a second-order factorisation machine over hashed words, structure and size.

A document is a sparse vector: its words in ``BUCKETS`` hashed places (relative frequency, square-rooted, unit length),
shape classes of words, and statistics of the text (share of upper case, marks, digits, repeated words, line ends, word
length, size).  Score: logistic of  w0 + <w, x> + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]: all pairwise
interactions in time linear in the non-zero values.  Trained by adaptive gradient steps on a bounded sample with class
weights that undo its balance, so scores are probabilities at the share of the labels.

Cases: NULL and empty texts have the statistics of an empty text; without labels of both classes all scores are the share
of label 1 (0 without labels); rows that repeat are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import bounded_batches
from tillworks.llm.sample import held_out, label_share, labelled_sample
from tillworks.llm.words import NO_LETTER, SPACE, slices, text_bytes, words

BITS = 15
BUCKETS = 1 << BITS
RANK = 8
SAMPLE = {0: 3_000, 1: 5_000}
SAMPLE_BYTES = 16_384  # on average: a class of the sample holds so many for each of its texts
EPOCHS = 20
BATCH = 256
RATE = 0.1
L2 = 1e-5
THRESHOLD = 0.3

_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
MARK = (_BYTES > 32) & (_BYTES < 127) & NO_LETTER
STATISTICS = 16


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None


@dataclass
class Rows:
    """Sparse rows: places and values, ``docs[i]:docs[i+1]`` of row i."""

    places: np.ndarray
    values: np.ndarray
    docs: np.ndarray


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def vectors(texts: pa.Array) -> Rows:
    """Sparse vectors of a string column."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    w, tokens = words(texts, NO_LETTER), words(texts, SPACE)
    doc, token_doc = w.doc_of(), tokens.doc_of()
    n_words, n_tokens = np.diff(w.docs).astype(float), np.diff(tokens.docs).astype(float)
    bucket = (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    pairs, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
    pair_doc = pairs // BUCKETS
    raw = np.sqrt(counts)
    norm = np.sqrt(np.bincount(pair_doc, counts, n))
    values = raw / np.maximum(norm[pair_doc], 1e-9)
    # structure: whole-text shares
    letters = np.maximum(size, 1)
    last = data[np.minimum(tokens.ends - 1, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    before = data[np.maximum(tokens.ends - 2, 0)] if len(data) else last
    one_mark = tokens.lengths() == 1
    per_token = np.maximum(n_tokens, 1)
    shares = [
        _per_doc(UPPER[data], offsets) / letters,
        _per_doc(DIGIT[data], offsets) / letters,
        _per_doc(MARK[data], offsets) / letters,
        _per_doc(data == 10, offsets) / letters * 10,
        _per_doc(data >= 128, offsets) / letters,
        np.bincount(token_doc, MARK[last] & MARK[before] & ~one_mark, n) / per_token,
        np.bincount(token_doc, one_mark & MARK[last], n) / per_token,
        np.bincount(token_doc, last == ord("."), n) / per_token,
        np.bincount(pair_doc, minlength=n) / np.maximum(n_words, 1),
        np.log1p(n_tokens) / 8,
        np.minimum(size / per_token / 10, 3),
        (n_tokens < 5).astype(float),
        np.bincount(pair_doc, raw == 1, n) / np.maximum(n_words, 1),
        (n_words / per_token).clip(0, 3),
        np.bincount(doc, w.lengths(), n) / np.maximum(n_words, 1) / 10,
        np.ones(n),
    ]
    dense = np.stack(shares, axis=1)
    places = np.concatenate([pair_doc, np.repeat(np.arange(n), STATISTICS)])
    all_places = np.concatenate([pairs % BUCKETS, np.tile(BUCKETS + np.arange(STATISTICS), n)])
    all_values = np.concatenate([values, dense.ravel()]).astype(np.float32)
    order = np.argsort(places, kind="stable")
    docs = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n))])
    return Rows(all_places[order], all_values[order], docs)


def raw_scores(model: Model, x: Rows) -> np.ndarray:
    """Of each row, by the sum-of-squares identity."""
    if not len(x.docs) - 1:
        return np.zeros(0)
    first = x.docs[:-1]
    out = model.bias + np.add.reduceat(model.linear[x.places] * x.values, first)
    for f in range(model.factors.shape[1]):  # one rank at a time: no rows-by-rank matrix of all values
        vx = model.factors[x.places, f] * x.values
        out = out + 0.5 * (np.add.reduceat(vx, first) ** 2 - np.add.reduceat(vx * vx, first))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(x: Rows, chosen: np.ndarray) -> Rows:
    sizes = (x.docs[1:] - x.docs[:-1])[chosen]
    docs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(x.docs[:-1][chosen] - docs[:-1], sizes) + np.arange(docs[-1])
    return Rows(x.places[at], x.values[at], docs)


def train(sample: pd.DataFrame, share: float) -> Model:
    """Fit to (text, label); ``share`` is the share of label 1 among all labels learned from."""
    y = sample["label"].to_numpy(float)
    size = BUCKETS + STATISTICS
    if not 0 < y.sum() < len(y):
        return Model(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), share)
    texts = pa.array(sample["text"])
    parts = [vectors(texts.slice(a, b - a)) for a, b in slices(texts, 1 << 20)]
    x = Rows(np.concatenate([p.places for p in parts]), np.concatenate([p.values for p in parts]),
             np.cumsum(np.concatenate([[0], *[np.diff(p.docs) for p in parts]])))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    random = np.random.default_rng(7)
    linear, factors, bias = np.zeros(size), random.normal(0, 0.01, (size, RANK)), np.zeros(1)
    seen = [np.full_like(a, 1e-6) for a in (linear, factors, bias)]
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            chosen = order[at:at + BATCH]
            b = _rows(x, chosen)
            first, doc = b.docs[:-1], np.repeat(np.arange(len(chosen)), np.diff(b.docs))
            v = factors[b.places]
            vx = v * b.values[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            z = (bias[0] + np.add.reduceat(linear[b.places] * b.values, first)
                 + 0.5 * (sums ** 2 - np.add.reduceat(vx * vx, first, axis=0)).sum(axis=1))
            g = weight[chosen] * (_sigmoid(z) - y[chosen]) / len(chosen)
            used, slot = np.unique(b.places, return_inverse=True)
            gx = g[doc] * b.values
            g_linear = np.bincount(slot, gx, len(used)) + L2 * linear[used]
            g_factors = L2 * factors[used]
            for f in range(RANK):
                g_factors[:, f] += np.bincount(slot, gx * (sums[doc, f] - vx[:, f]), len(used))
            for params, grad, held, where in ((linear, g_linear, seen[0], used), (factors, g_factors, seen[1], used),
                                              (bias, np.array([g.sum()]), seen[2], np.array([0]))):
                held[where] += grad ** 2
                params[where] -= RATE * grad / np.sqrt(held[where])
    return Model(float(bias[0]), linear.astype(np.float32), factors.astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``row``, and ``score``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]):
        fitted = shared.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, 4 << 20):
                if fitted.constant is not None:
                    scores = np.full(b - a, fitted.constant)
                else:
                    scores = _sigmoid(raw_scores(fitted, vectors(texts.slice(a, b - a))).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], ["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType),
                                              T.StructField("score", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return train(labelled_sample(docs, labels, label, SAMPLE, SAMPLE_BYTES), label_share(labels, label))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("row.doc_id", "score").withColumn("held_out", held_out()).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
