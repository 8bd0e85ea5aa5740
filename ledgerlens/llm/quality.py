"""Operator 6: a quality classifier by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w.x) with one weight vector for all grades and ordered
thresholds. x is the mean over a text's words of their hashed word and character-gram features, so
a word has one number, and a text's score is the mean of its words' numbers. The expected grade and
the probability of a grade or more come from the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import chunks, words
from .word_features import gram_means, labelled_sample, word_features

WORD_BITS, GRAM_BITS = 16, 16
FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: The regression learns from at most so many doc_ids of each grade and bytes of whole texts.
SAMPLE, SAMPLE_BYTES = 1500, 6 << 20
#: Bytes of text taken at a time.
TEXT_BYTES = 3 << 20
STEPS, RATE, DECAY = 120, 0.3, 1e-4


class Model(NamedTuple):
    weights: np.ndarray     # words first, then character grams
    thresholds: np.ndarray  # ascending, one fewer than grades

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 and up, a column each."""
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def text_features(text: pa.Array):
    """Per text: hashed features and their shares; the bounds of each text's features."""
    found = words(text)
    buckets, grams, bounds = word_features(found.vocabulary, WORD_BITS, GRAM_BITS)
    sizes = np.diff(bounds)
    out, shares, ends = [], [], [0]
    for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True):
        which, count = np.unique(found.index[a:b], return_counts=True)
        own = sizes[which]
        at = np.arange(own.sum()) + np.repeat(bounds[which] - np.cumsum(own) + own, own)
        key = np.concatenate((buckets[which], grams[at] + (1 << WORD_BITS)))
        value = np.concatenate((count, np.repeat(count / own, own))) / max(1, b - a)
        key, inverse = np.unique(key, return_inverse=True)
        out.append(key.astype(np.int32))
        shares.append(np.bincount(inverse, value, len(key)).astype(np.float32))
        ends.append(ends[-1] + len(key))
    return out, shares, ends


def train(keys: list[np.ndarray], shares: list[np.ndarray], grades: list[int], n_grades: int) -> Model:
    """Maximum likelihood with weight decay, by Adam over all rows; thresholds stay ordered."""
    if not grades:  # nothing is known, so no grade over 0 is likely
        return Model(np.zeros(FEATURES, np.float32), np.full(n_grades - 1, np.inf))
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate([np.zeros(0, np.int32), *keys])
    share = np.concatenate([np.zeros(0, np.float32), *shares])
    y = np.array(grades, np.int64)
    n = max(1, len(y))
    share_of = np.array([(y >= k).mean() if len(y) else 0.5 for k in range(1, n_grades)])
    share_of = np.clip(share_of, 0.01, 0.99)
    first = -np.log(share_of[0] / (1 - share_of[0])) if n_grades > 1 else 0.0
    gaps = np.diff(np.maximum.accumulate(-np.log(share_of / (1 - share_of))))
    # the first threshold, then logs of the steps between neighbours
    theta = np.concatenate(([first], np.log(np.maximum(gaps, 0.1))))[:max(0, n_grades - 1)]
    w = np.zeros(FEATURES)
    moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(len(theta)), np.zeros(len(theta))]
    for step in range(1, STEPS + 1):
        thresholds = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        score = np.bincount(row, share * w[key], n)
        up = np.hstack((np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))))
        if not len(y):
            break
        own = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-9)
        slope = up * (1 - up)
        d_score = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / own / n
        d_threshold = np.zeros(len(theta))
        np.add.at(d_threshold, y[y > 0] - 1, (slope[np.arange(n), y] / own / n)[y > 0])
        inner = y < n_grades - 1
        np.add.at(d_threshold, y[inner], -(slope[np.arange(n), y + 1] / own / n)[inner])
        d_theta = np.cumsum(d_threshold[::-1])[::-1] * np.concatenate((np.ones(1), np.exp(theta[1:])))[:len(theta)]
        d_w = np.bincount(key, share * d_score[row], FEATURES) + DECAY * w / n
        for value, gradient, m, v in ((w, d_w, *moments[:2]), (theta, d_theta, *moments[2:])):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient ** 2 - v)
            value -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rated doc_ids of each grade; whole texts, as features.

    ``ratings`` has doc_id and what ``grade`` needs; null grades are left out. Without any rated row
    every text has grade 0 and none is selected.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            keys, shares, ends = text_features(chunk.column("text"))
            bounds = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "label": chunk.column("label"),
                "keys": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(keys))),
                "shares": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(shares)))})

    rows = labelled_sample(docs, ratings, grade, {k: sample for k in range(n_grades)}, SAMPLE_BYTES)
    table = rows.select("doc_id", "text", "label").mapInArrow(
        features, "doc_id bigint, label int, keys array<int>, shares array<float>").toArrow()
    table = table.sort_by("doc_id")
    keys = [k.values.to_numpy() for k in table.column("keys")]
    shares = [s.values.to_numpy() for s in table.column("shares")]
    return train(keys, shares, table.column("label").to_pylist(), n_grades)


def grade_texts(docs: DataFrame, model: Model, select_grade: int, select_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of ``select_grade`` or more) and selected, for every row.

    Texts without words, empty and null ones have no features: their grade follows from the
    thresholds alone and they are not selected. Repeated rows all stay. Only doc_id and text are
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of_word, of_gram = model.weights[:1 << WORD_BITS], model.weights[1 << WORD_BITS:]
        for chunk in chunks(batches, limit=TEXT_BYTES):
            found = words(chunk.column("text"))
            count = np.diff(found.offsets)
            score = np.zeros(chunk.num_rows)
            if len(found.index):
                buckets, grams, bounds = word_features(found.vocabulary, WORD_BITS, GRAM_BITS)
                number = of_word[buckets] + gram_means(of_gram, grams, bounds)
                sums = np.concatenate(([0.0], np.cumsum(number[found.index], dtype=np.float64)))
                score = (sums[found.offsets[1:]] - sums[found.offsets[:-1]]) / np.maximum(1, count)
            tails = model.at_least(score)
            tail = tails[:, select_grade - 1]
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "expected_grade": pa.array(tails.sum(axis=1)),
                "tail_prob": pa.array(tail), "selected": pa.array((tail >= select_at) & (count > 0))})

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(run, "doc_id bigint, expected_grade double, tail_prob double, selected boolean")
