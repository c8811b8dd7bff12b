"""Toxic spans by a linear-chain conditional random field over words.

Training.  Labels say which documents are toxic, not which words, so words of the training sample are tagged first: a word
or a productive stem (first bytes shared by several words) marks a span when most of its documents are toxic, and more
of them than chance allows over all candidates (a large-deviation bound); only toxic documents get marks.  Near copies
count once: documents are weighted by one over the number of those that share a minimal shingle hash.  The chain (tags:
clean, toxic) is then fitted to the tagged words of the whole sample by gradient ascent on its log-likelihood,
expectations coming from the forward-backward recursion.

Scoring.  Marginals of every word of the whole text by forward-backward; a document's score is a logistic function, fitted
on the same sample, of its largest marginal and its expected number of toxic words; words whose marginal reaches
``SPAN`` are returned as spans.  The model (a few thousand numbers) travels with the tasks.  A text longer than ``PIECE`` is read
in parts that end where no word runs: once forward, keeping the state at each border, and once backward with it, so a
task holds the text itself and the arrays of one part.

Letters are folded one by one (a letter whose lower case is two letters keeps its place), so spans hold in the text as given.

Cases: NULL and empty texts have no words and get the score of a document without toxic words; without texts of both
classes all scores are the share of toxic labels (0 without labels); rows that repeat are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import bounded_batches
from tillworks.llm.sample import held_out, label_share, sample_rows
from tillworks.llm.tokens import PIECE_BYTES, pieces
from tillworks.llm.words import NO_LETTER, Words, mix, slices, words

if TYPE_CHECKING:
    import pandas as pd

SAMPLE = {0: 4_000, 1: 2_000}
SAMPLE_BYTES = 8_192  # on average: a class of the sample holds so many for each of its texts
STEMS = (4, 5, 6, 7)
STEM_WORDS = 5
PURITY = 0.5
COMMON = 200
SPAN = 0.5
STEPS = 60
RATE = 0.3
L2 = 1e-4
SEGMENT = 128  # words of a piece of a chain
PART_WORDS = 1 << 18
PIECE = 1 << 18  # bytes of text that are worked on at once
#: A model as a row, as the task that trains it returns it.
MODEL_SCHEMA = ("features array<bigint>, weights array<double>, bias double, start array<double>, moves array<double>, "
                "document array<double>, constant double")
MODEL_ROW = pa.schema([("features", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64()),
                       ("start", pa.list_(pa.float64())), ("moves", pa.list_(pa.float64())),
                       ("document", pa.list_(pa.float64())), ("constant", pa.float64())])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    start: np.ndarray
    moves: np.ndarray
    document: np.ndarray  # intercept, weight of the largest marginal's logit, weight of the expected count
    constant: float | None = None


def _feature_hashes(w: Words) -> list[np.ndarray]:
    """Word and stems; 0 where a word is not longer than the stem."""
    lengths = w.lengths()
    return [w.hashes(), *[np.where(lengths > k, mix(w.hashes(k) + np.uint64(k)), np.uint64(0)) for k in STEMS]]


class Lookup:
    """Positions of hashes in a sorted array of features; most hashes are not in it, which a small table tells first."""

    BITS = 20

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[features >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hashes, feature) of those found."""
        place = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.BITS)])
        if not len(place):
            return place, place
        at = np.searchsorted(self.features, hashes[place])
        at[at == len(self.features)] = 0
        same = self.features[at] == hashes[place]
        return place[same], at[same]


class _Runs:
    """Documents laid out as pieces of at most ``SEGMENT`` words, by falling length, so that step t works on the first
    ``active[t]`` of them at once.  A piece passes on its state as a function of the state it starts from (a 2 x 2 matrix),
    so a long document takes as many steps as a piece has words and as the document has pieces."""

    def __init__(self, docs: np.ndarray):
        pieces = -(-np.diff(docs) // SEGMENT)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(docs[:-1], pieces) + number * SEGMENT
        size = np.minimum(np.repeat(docs[1:], pieces) - first, SEGMENT)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.first, sizes = first[order], size[order]
        self.active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        followed = np.flatnonzero(number + 1 < np.repeat(pieces, pieces))
        followed = followed[np.argsort(number[followed], kind="stable")]
        self.followed, self.next = place[followed], place[followed + 1]
        self.rounds = np.concatenate([[0], np.cumsum(np.bincount(number[followed]))]) if len(followed) else np.zeros(1, int)

    def carry(self, own: np.ndarray, moves: np.ndarray, begin: float) -> np.ndarray:
        """Odds of toxic at each word from all words before it.  own: odds by the word itself; moves: factors."""
        t00, t01, t10, t11 = moves.ravel()
        state = np.full(len(self.first), begin)
        if len(self.followed):
            at = self.first[self.followed]
            a, b, c, d = (np.full(len(at), v) for v in (1.0, 0.0, 0.0, 1.0))  # clean, toxic by the two first states
            for t in range(SEGMENT):
                x = own[at + t]
                c, d = c * x, d * x
                a, b, c, d = t00 * a + t10 * c, t00 * b + t10 * d, t01 * a + t11 * c, t01 * b + t11 * d
                total = a + b + c + d
                a, b, c, d = a / total, b / total, c / total, d / total
            for lo, hi in zip(self.rounds[:-1], self.rounds[1:], strict=True):
                before = state[self.followed[lo:hi]]
                state[self.next[lo:hi]] = (c[lo:hi] + d[lo:hi] * before) / (a[lo:hi] + b[lo:hi] * before)
        out = np.empty(len(own))
        for t, k in enumerate(self.active):
            here = self.first[:k] + t
            out[here] = state[:k]
            x = state[:k] * own[here]
            state[:k] = (t01 + t11 * x) / (t00 + t10 * x)
        return out


class Chains:
    """Documents as chains of words: ``docs[i]:docs[i+1]`` are the words of document i."""

    def __init__(self, docs: np.ndarray):
        docs = np.asarray(docs)
        self.ahead, self.behind = _Runs(docs), _Runs(docs[-1] - docs[::-1])
        self.firsts = docs[:-1][np.diff(docs) > 0]

    def marginals(self, emission: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """P(toxic) of each word, and with ``pairs`` the summed probabilities of tag pairs.  emission: the score of tag
        toxic, that of clean being 0.  A state is kept as the odds of toxic before the word itself, which the moves bound, so
        nothing under- or overflows."""
        own, factors = np.exp(np.clip(emission, -300, 300)), np.exp(moves - moves.max())
        left = self.ahead.carry(own, factors, float(np.exp(start[1] - start[0]))) * own
        right = self.behind.carry(own[::-1], factors.T, 1.0)[::-1]
        odds = left * right
        p = odds / (1 + odds)
        if not pairs:
            return p
        inner = np.ones(len(own), bool)
        inner[self.firsts] = False
        here = np.flatnonzero(inner)
        x, y = left[here - 1], own[here] * right[here]
        total = factors[0, 0] + factors[0, 1] * y + (factors[1, 0] + factors[1, 1] * y) * x
        return p, factors * [[(1 / total).sum(), (y / total).sum()], [(x / total).sum(), (x * y / total).sum()]]


class Border:
    """One chain in parts: the odds that enter a part from its left or right end, and those it hands on."""

    def __init__(self, emission: np.ndarray, moves: np.ndarray):
        self.own, self.factors = np.exp(np.clip(emission, -300, 300)), np.exp(moves - moves.max())
        self.runs = _Runs(np.array([0, len(emission)]))

    def _pass(self, own: np.ndarray, factors: np.ndarray, begin: float) -> tuple[np.ndarray, float]:
        odds = self.runs.carry(own, factors, begin)
        x = odds[-1] * own[-1]
        return odds, float((factors[0, 1] + factors[1, 1] * x) / (factors[0, 0] + factors[1, 0] * x))

    def forward(self, begin: float) -> tuple[np.ndarray, float]:
        return self._pass(self.own, self.factors, begin)

    def backward(self, begin: float) -> tuple[np.ndarray, float]:
        odds, last = self._pass(self.own[::-1], self.factors.T, begin)
        return odds[::-1], last


def _sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes of each distinct word, a row for each kind; number of each word; first word of each document and the
    end), a piece of text at a time: a distinct word is kept once, a word takes 4 bytes."""
    kinds = np.zeros((1 + len(STEMS), 0), np.uint64)
    known, number_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes and the numbers of their words
    numbers, sizes = [], [np.zeros(1, np.int64)]
    for a, b in slices(texts, PIECE):
        w = words(texts.slice(a, b - a), NO_LETTER)
        hashes = _feature_hashes(w)
        names, first, at = np.unique(hashes[0], return_index=True, return_inverse=True)
        place = np.searchsorted(known, names)
        new = np.ones(len(names), bool)
        inside = place < len(known)
        new[inside] = known[place[inside]] != names[inside]
        own = np.empty(len(names), np.int32)
        own[~new] = number_of[place[~new]]
        own[new] = kinds.shape[1] + np.arange(new.sum(), dtype=np.int32)
        kinds = np.concatenate([kinds, np.stack([h[first[new]] for h in hashes])], axis=1)
        known, number_of = np.insert(known, place[new], names[new]), np.insert(number_of, place[new], own[new])
        numbers.append(own[at])
        sizes.append(np.diff(w.docs))
    return kinds, np.concatenate(numbers or [np.zeros(0, np.int32)]), np.cumsum(np.concatenate(sizes))


def _copy_weights(docs: np.ndarray, names: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One over the number of sample documents that share a minimal hash of three words (two hashes; the larger group
    counts).  ``names[word]`` are the hashes of the words."""
    n = len(docs) - 1
    size, some = np.ones(n), np.diff(docs) > 0
    least = np.zeros((2, n), np.uint64)
    for i, j in _document_ranges(docs, PART_WORDS):
        lo, hi = docs[i], docs[j]
        hashes = names[word[lo:hi]]
        joined = hashes.copy()
        joined[:-1] = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        joined[:-2] = mix(joined[:-2] + hashes[2:] * np.uint64(5))
        here = np.flatnonzero(some[i:j])
        for salt in (1, 2) if len(here) else ():
            least[salt - 1, i + here] = np.minimum.reduceat(mix(joined + np.uint64(salt)), docs[i:j][here] - lo)
    for row in least:
        _, group, count = np.unique(row[some], return_inverse=True, return_counts=True)
        size[some] = np.maximum(size[some], count[group])
    return 1 / size


def _document_ranges(docs: np.ndarray, most: int):
    """(first, last) ranges of documents of about ``most`` words, or one document if that is longer."""
    at = 0
    while at < len(docs) - 1:
        end = max(at + 1, int(np.searchsorted(docs, docs[at] + most, "right")) - 1)
        yield at, end
        at = end


def _evidence(hashes: np.ndarray, word: np.ndarray, docs: np.ndarray, toxic: np.ndarray, weight: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, toxic weight, clean weight): weights of the documents that hold each feature, some documents at a time.
    ``hashes`` are the features of the distinct words, 0 where there is none."""
    names, feature = np.unique(hashes, return_inverse=True)
    bad, good = np.zeros(len(names)), np.zeros(len(names))
    for i, j in _document_ranges(docs, PART_WORDS):
        doc = np.repeat(np.arange(j - i), np.diff(docs[i:j + 1]))
        doc, at = np.divmod(np.unique(doc * len(names) + feature[word[docs[i]:docs[j]]]), len(names))
        bad += np.bincount(at, (weight * toxic)[i + doc], len(names))
        good += np.bincount(at, (weight * (1 - toxic))[i + doc], len(names))
    some = (names != 0) & (bad + good > 0)
    return names[some], bad[some], good[some]


def train(sample: pd.DataFrame | pa.Table, share: float | None = None) -> Model:
    """Fit to (text, label); ``share`` is the share of label 1 among all labels learned from, that of the sample if not given."""
    toxic = np.asarray(sample["label"], float)
    if not 0 < toxic.sum() < len(toxic):
        if share is None:
            share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros(3), share)
    texts = sample["text"]
    kinds, word, all_docs = _sample_features(texts.combine_chunks() if isinstance(sample, pa.Table) else pa.array(texts))
    weight = _copy_weights(all_docs, kinds[0], word)
    base = (weight * toxic).sum() / weight.sum()
    marks, common = [], np.zeros(0, np.uint64)
    for number, hashes in enumerate(kinds):
        names, bad, good = _evidence(hashes, word, all_docs, toxic, weight)
        if number == 0:
            common = names[np.argsort(-(bad + good))[:COMMON]]
        else:  # stems that several words share
            shared, n = np.unique(hashes[hashes != 0], return_counts=True)
            productive = np.isin(names, shared[n >= STEM_WORDS])
            names, bad, good = names[productive], bad[productive], good[productive]
        if len(names):
            pure = np.clip(bad / (bad + good), 1e-9, 1 - 1e-9)
            surprise = (bad + good) * (pure * np.log(pure / base) + (1 - pure) * np.log((1 - pure) / (1 - base)))
            marks.append(names[(pure >= PURITY) & (surprise >= math.log(len(names)) + math.log(100))])
    marks = np.unique(np.concatenate(marks))
    features = np.unique(np.concatenate([marks, common]))
    if not len(features):
        features = np.array([1], np.uint64)
    lookup = Lookup(features)
    held = []  # feature of each distinct word by kind, -1 where there is none
    marked = np.zeros(len(kinds[0]), bool)
    for hashes in kinds:
        at, feature = lookup.find(hashes)
        held.append(np.full(len(hashes), -1, np.int32))
        held[-1][at] = feature
        marked[at] |= np.isin(features[feature], marks)
    tag = marked[word] & np.repeat(toxic == 1, np.diff(all_docs))
    firsts = all_docs[:-1][np.diff(all_docs) > 0]
    later = np.ones(len(tag), bool)
    later[firsts] = False
    here = np.flatnonzero(later)
    true_pairs = np.array([[((tag[here - 1] == a) & (tag[here] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    true_start = np.array([(tag[firsts] == 0).sum(), (tag[firsts] == 1).sum()], float)
    parts = []  # the whole sample, some documents at a time: what a step holds is bounded by them
    for i, j in _document_ranges(all_docs, PART_WORDS):
        lo, hi = all_docs[i], all_docs[j]
        found = [h[word[lo:hi]] for h in held]
        at = [np.flatnonzero(f >= 0).astype(np.int32) for f in found]
        which = np.concatenate([f[a] for f, a in zip(found, at, strict=True)])
        parts.append((Chains(all_docs[i:j + 1] - lo), np.concatenate(at), which, tag[lo:hi], all_docs[i:j + 1] - lo))
    del word, found, at, which
    weights, bias, start, moves = np.zeros(len(features)), 0.0, np.zeros(2), np.zeros((2, 2))
    params = np.zeros(len(features) + 7)
    m, v = np.zeros_like(params), np.zeros_like(params)
    scale = max(1.0, tag.sum())
    for step in range(1, STEPS + 1):
        weights, bias, start, moves = (params[:len(features)], params[len(features)], params[-6:-4],
                                       params[-4:].reshape(2, 2))
        gradient = np.concatenate([np.zeros(len(features) + 1), true_start, true_pairs.ravel()])
        for chains, at, which, y, _ in parts:
            p, pair = chains.marginals(bias + np.bincount(at, weights[which], len(y)), start, moves, True)
            rest, first = y - p, p[chains.firsts]
            gradient += np.concatenate([np.bincount(which, rest[at], len(features)), [rest.sum()],
                                        [-(1 - first).sum(), -first.sum()], -pair.ravel()])
        gradient = gradient / scale - L2 * params
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        params = params + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights, bias, start, moves = (params[:len(features)].copy(), float(params[len(features)]), params[-6:-4].copy(),
                                   params[-4:].reshape(2, 2).copy())
    model = Model(features, weights, bias, start, moves, np.zeros(3))
    x = np.concatenate([_document_values(chains.marginals(bias + np.bincount(at, weights[which], len(y)), start, moves), docs)
                        for chains, at, which, y, docs in parts])
    model.document = _logistic(x, toxic, weight)
    return model


def _document_values(p: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """(1, logit of the largest marginal, log of 1 + expected toxic words) of each document."""
    n = len(docs) - 1
    largest, expected = np.zeros(n), np.zeros(n)
    some = np.diff(docs) > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, docs[:-1][some])
        expected[some] = np.add.reduceat(np.where(p >= 0.05, p, 0), docs[:-1][some])
    return _value_rows(largest, expected)


def _value_rows(largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
    clipped = np.clip(largest, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(largest)), np.log(clipped / (1 - clipped)), np.log1p(expected)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * b)
        b = b + np.clip(step, -2, 2)
    return b


def folded(texts: pa.Array) -> pa.Array:
    """Lower case letter by letter: the number of code points stays."""
    return pc.utf8_lower(texts)


def emissions(model: Model, lookup: Lookup, w: Words) -> np.ndarray:
    out = np.full(len(w.starts), model.bias)
    for hashes in _feature_hashes(w):
        place, feature = lookup.find(hashes)
        np.add.at(out, place, model.weights[feature])
    return out


def _scores(model: Model, values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(values @ model.document)))


def tag_batch(model: Model, lookup: Lookup, texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
    """(document scores, words, marginals) of a string column."""
    w = words(folded(texts), NO_LETTER)
    p = Chains(w.docs).marginals(emissions(model, lookup, w), model.start, model.moves)
    return _scores(model, _document_values(p, w.docs)), w, p


def _span_lists(w: Words, marked: np.ndarray) -> list[list[dict[str, int]]]:
    """(start, end) of marked words of each text, in code points."""
    out: list[list[dict[str, int]]] = [[] for _ in range(len(w.docs) - 1)]
    if not len(marked):
        return out
    points = np.concatenate([[0], np.cumsum(w.data & 0xC0 != 0x80, dtype=np.int32)])
    doc = np.searchsorted(w.docs, marked, "right") - 1
    first = points[w.texts[doc]]
    for d, lo, hi in zip(doc.tolist(), (points[w.starts[marked]] - first).tolist(), (points[w.ends[marked]] - first).tolist(),
                         strict=True):
        out[d].append({"start": lo, "end": hi})
    return out


def tag_long(model: Model, lookup: Lookup, parts: list[pa.Array], spans: bool) -> tuple[float, list[dict[str, int]]]:
    """(score, spans) of one text in parts."""
    enters, state = [], float(np.exp(model.start[1] - model.start[0]))
    for part in parts:
        enters.append(state)
        w = words(folded(part), NO_LETTER)
        if len(w.starts):
            state = Border(emissions(model, lookup, w), model.moves).forward(state)[1]
    largest, expected, found, state = 0.0, 0.0, [], 1.0
    for part, enter in zip(parts[::-1], enters[::-1], strict=True):
        w = words(folded(part), NO_LETTER)
        p = np.zeros(0)
        if len(w.starts):
            border = Border(emissions(model, lookup, w), model.moves)
            right, state = border.backward(state)
            odds = border.forward(enter)[0] * border.own * right
            p = odds / (1 + odds)
            largest, expected = max(largest, float(p.max())), expected + float(p[p >= 0.05].sum())
        found.append((_span_lists(w, np.flatnonzero(p >= SPAN))[0] if spans else [], pc.utf8_length(part)[0].as_py()))
    out, at = [], 0
    for marked, size in found[::-1]:
        out += [{"start": s["start"] + at, "end": s["end"] + at} for s in marked]
        at += size
    return float(_scores(model, _value_rows(np.array([largest]), np.array([expected])))[0]), out


def score_column(model: Model, lookup: Lookup, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, list]:
    """(scores, spans) of a string column, a piece at a time."""
    if model.constant is not None:
        return np.full(len(texts), model.constant), [[]] * len(texts)
    scores, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    long: dict[int, list[pa.Array]] = {}
    for first, part, _ in pieces(texts.fill_null(""), PIECE):
        if len(part) == 1 and len(part[0].as_buffer()) < len(texts[first].as_buffer() or b""):
            long.setdefault(first, []).append(part)
            continue
        here, w, p = tag_batch(model, lookup, part)
        scores[first:first + len(part)] = here
        if spans:
            found[first:first + len(part)] = _span_lists(w, np.flatnonzero(p >= SPAN))
    for row, parts in long.items():
        scores[row], found[row] = tag_long(model, lookup, parts, spans)
    return scores, found


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``docs`` in ``row``, ``score``, and with ``spans`` the toxic words of each text as (start, end) in
    code points."""
    bounded_batches(docs.sparkSession, PIECE_BYTES)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]):
        lookup = Lookup(model.features)
        for batch in batches:
            scores, found = score_column(model, lookup, batch.column(0).field(text), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(found, kind)], ["row", "score", "spans"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(run, schema)


def _train_in_task(sample: pa.Table, share: float) -> pa.Table:
    """The model of a sample of unfolded texts as one row."""
    sample = sample.sort_by([("label", "ascending"), ("text", "ascending")])
    model = train(pa.table({"label": sample["label"], "text": folded(sample["text"])}), share)
    columns = [model.features.view(np.int64), model.weights, model.bias, model.start, model.moves.ravel(), model.document,
               model.constant]
    return pa.table([pa.array([c], kind) for c, kind in zip(columns, MODEL_ROW.types, strict=True)], MODEL_ROW)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The sample, which ``SAMPLE`` and ``SAMPLE_BYTES`` bound whatever the table, goes to one task; the driver gets the model only."""
    share = label_share(labels, label)
    bounded_batches(docs.sparkSession, PIECE_BYTES)
    sample = sample_rows(docs, labels, label, SAMPLE, SAMPLE_BYTES)
    row = sample.groupBy().applyInArrow(lambda found: _train_in_task(found, share), MODEL_SCHEMA).first()
    if row is None:  # no text to learn from
        return train(pa.table({"label": pa.array([], pa.int32()), "text": pa.array([], pa.string())}), share)
    return Model(np.array(row.features, np.int64).view(np.uint64), np.array(row.weights, float), row.bias, np.array(row.start),
                 np.array(row.moves).reshape(2, 2), np.array(row.document), row.constant)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document."""
    narrow = docs.select("doc_id", "text")
    scored = score(narrow, fit(docs, labels))
    return scored.select("row.doc_id", "score", "spans").withColumn("held_out", held_out()).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
