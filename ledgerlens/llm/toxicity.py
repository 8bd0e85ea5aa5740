"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling.

A word is the embedding of its hash beside the mean embedding of its character grams, so new forms
of a known stem are still seen. Two gated recurrent units read a window in both directions;
attention weighs their states and the words, and a linear layer gives the window's log odds. A
text's score is that of its highest window, over overlapping windows that cover all of it. The
network learns in numpy from labelled documents alone: of a document the currently highest window
carries its label, after some rounds on random windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import chunks, kept_rows, words
from .word_features import gram_means, labelled_sample, remainder, word_features

WINDOW, STRIDE = 32, 24
WORD_BITS, GRAM_BITS, WORD_SIZE, GRAM_SIZE = 13, 15, 4, 12
HIDDEN, ATTENTION = 8, 8
INPUT = WORD_SIZE + GRAM_SIZE
STATE = 2 * HIDDEN + INPUT
#: The network learns from at most so many labelled doc_ids of either label and bytes of whole texts.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_BYTES = 1000, 1600, 10 << 20
#: Windows are chosen anew after each CHOOSE rounds.
ROUNDS, RANDOM_ROUNDS, CHOOSE, BATCH, RATE = 13, 3, 2, 128, 0.01
THRESHOLD = 0.7
#: Bytes of text scored together.
TEXT_BYTES = 6 << 20


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows over n words; the last ends with the text. None for no words."""
    if not n:
        return np.zeros(0, np.int64)
    last = max(0, n - WINDOW)
    return np.unique(np.append(np.arange(0, last, STRIDE), last))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.weights = {
            "words": normal(1 << WORD_BITS, WORD_SIZE, scale=0.1),
            "grams": normal(1 << GRAM_BITS, GRAM_SIZE, scale=0.2),
            "input": normal(INPUT, 6 * h, scale=INPUT ** -0.5), "input_bias": np.zeros(6 * h, np.float32),
            "forth": normal(h, 3 * h, scale=h ** -0.5), "back": normal(h, 3 * h, scale=h ** -0.5),
            "attend": normal(STATE, ATTENTION, scale=STATE ** -0.5), "query": normal(ATTENTION, scale=0.5),
            "out": normal(STATE, scale=0.3), "bias": np.array([-1.0], np.float32)}

    def embed(self, buckets: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.hstack((w["words"][buckets], gram_means(w["grams"], grams, bounds))).astype(np.float32)

    def run(self, x: np.ndarray, projected: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Log odds of windows of word numbers (time, window); -1 is no word. Keeps for learning."""
        w, h = self.weights, HIDDEN
        steps, n = windows.shape
        real = (windows >= 0).astype(np.float32)[:, :, None]
        states = np.empty((steps, n, STATE), np.float32)
        kept: dict = {"forth": {}, "back": {}}
        for name, order, at in (("forth", range(steps), 0), ("back", range(steps - 1, -1, -1), h)):
            u, state = w[name], np.zeros((n, h), np.float32)
            mine = projected[:, 3 * at:3 * at + 3 * h]
            for t in order:
                a = mine[windows[t]]
                b = state @ u
                gates = sigmoid(a[:, :2 * h] + b[:, :2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
                if keep:
                    kept[name][t] = (state, z, r, new, b[:, 2 * h:])
                state = state + real[t] * (1 - z) * (new - state)
                states[t, :, at:at + h] = state
        states[:, :, 2 * h:] = x[windows] * real
        hidden = np.tanh(states @ w["attend"])
        energy = hidden @ w["query"] - 1e9 * (1 - real[:, :, 0])
        share = np.exp(energy - energy.max(axis=0))
        share *= real[:, :, 0] / share.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", share, states)
        odds = pooled @ w["out"] + w["bias"][0]
        return (odds, (real, states, hidden, share, pooled, kept)) if keep else odds

    def learn(self, features, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        w, h = self.weights, HIDDEN
        buckets, grams, bounds = features
        vocabulary, local = np.unique(windows, return_inverse=True)
        local = local.reshape(windows.shape)
        if vocabulary[0] < 0:
            vocabulary, local = vocabulary[1:], local - 1
        sizes = bounds[vocabulary + 1] - bounds[vocabulary]
        own_bounds = np.concatenate(([0], np.cumsum(sizes)))
        own = grams[np.arange(own_bounds[-1]) + np.repeat(bounds[vocabulary] - own_bounds[:-1], sizes)]
        x = self.embed(buckets[vocabulary], own, own_bounds)
        projected = x @ w["input"] + w["input_bias"]
        odds, (real, states, hidden, share, pooled, kept) = self.run(x, projected, local, keep=True)
        n = len(target)
        d_odds = ((sigmoid(odds) - target) / n).astype(np.float32)
        g = {"out": pooled.T @ d_odds, "bias": d_odds.sum(keepdims=True)}
        d_pooled = d_odds[:, None] * w["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("tns,ns->tn", states, d_pooled)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["query"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * w["query"] * (1 - hidden ** 2)
        g["attend"] = np.einsum("tns,tna->sa", states, d_hidden)
        d_states = d_states + d_hidden @ w["attend"].T
        d_projected = np.zeros((len(x) + 1, 6 * h), np.float32)
        for name, order, at in (("forth", range(len(local) - 1, -1, -1), 0), ("back", range(len(local)), h)):
            u, carry = w[name], np.zeros((n, h), np.float32)
            g[name] = np.zeros_like(u)
            for t in order:
                state, z, r, new, b = kept[name][t]
                d = d_states[t, :, at:at + h] + carry
                live = d * real[t]
                d_new = live * (1 - z) * (1 - new ** 2)
                d_z = live * (state - new) * z * (1 - z)
                d_r = d_new * b * r * (1 - r)
                d_b = np.hstack((d_z, d_r, d_new * r))
                g[name] += state.T @ d_b
                carry = d - live + live * z + d_b @ u.T
                np.add.at(d_projected[:, 3 * at:3 * at + 3 * h], local[t], np.hstack((d_z, d_r, d_new)))
        d_projected = d_projected[:-1]  # what fell on -1, no word
        g["input"], g["input_bias"] = x.T @ d_projected, d_projected.sum(axis=0)
        d_x = np.zeros((len(x) + 1, INPUT), np.float32)
        np.add.at(d_x, local, d_states[:, :, 2 * h:] * real)
        d_x = d_x[:-1] + d_projected @ w["input"].T
        g["words"], g["grams"] = np.zeros_like(w["words"]), np.zeros_like(w["grams"])
        np.add.at(g["words"], buckets[vocabulary], d_x[:, :WORD_SIZE])
        np.add.at(g["grams"], own, np.repeat(d_x[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
        return g

    def scores(self, features, windows: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Log odds of windows (window, time) over words with the given features."""
        x = self.embed(*features)
        projected = x @ self.weights["input"] + self.weights["input_bias"]
        out = [self.run(x, projected, windows[a:a + batch].T) for a in range(0, len(windows), batch)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)


def windows_of(index: np.ndarray, offsets: np.ndarray):
    """Windows (window, time) of word numbers, -1 past the end; the text of each window."""
    starts = [window_starts(int(n)) for n in np.diff(offsets)]
    text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    begin = np.concatenate([np.zeros(0, np.int64), *starts]) + offsets[text]
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offsets[text + 1][:, None]
    padded = np.append(index, -1)
    return np.where(inside, padded[np.minimum(at, len(index))], -1), text


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network:
    """A network from whole texts and their labels (0 or 1)."""
    network, draw = Network(seed), np.random.default_rng(seed)
    found = words(pa.array(texts, pa.large_string()))
    windows, text = windows_of(found.index, found.offsets)
    if not len(windows):
        return network
    features = word_features(found.vocabulary, WORD_BITS, GRAM_BITS)
    target = np.array(labels, np.float32)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    count = np.diff(np.append(first, len(text)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.weights.items()}
    step, batch = 0, int(np.clip(len(first) // 16, 8, BATCH))  # few documents take smaller steps
    for round_ in range(ROUNDS):
        if round_ < RANDOM_ROUNDS:
            chosen = first + (draw.random(len(first)) * count).astype(np.int64)
        elif (round_ - RANDOM_ROUNDS) % CHOOSE == 0:
            odds = network.scores(features, windows) + draw.random(len(windows)) * 1e-6
            top = np.maximum.reduceat(odds, first)
            chosen = np.flatnonzero(odds == top[np.repeat(np.arange(len(first)), count)])
        draw.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            mine = chosen[a:a + batch]
            gradients = network.learn(features, windows[mine].T, target[text[mine]])
            step += 1
            rate = RATE * (1 - 0.9 * round_ / ROUNDS) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in gradients.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.weights[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return network


def _scores(network: Network, texts: pa.Array) -> np.ndarray:
    """Score of each text: that of its highest window."""
    found = words(texts)
    out = np.full(len(texts), float(network.weights["bias"][0]))
    windows, text = windows_of(found.index, found.offsets)
    if len(windows):
        odds = network.scores(word_features(found.vocabulary, WORD_BITS, GRAM_BITS), windows)
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[first]] = np.maximum.reduceat(odds, first)
    return sigmoid(out)


def drop_toxic(docs: DataFrame, network: Network) -> DataFrame:
    """Rows of ``docs``, with all columns, whose score is under THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kept_rows(batches, lambda text: _scores(shared.value, text) >= THRESHOLD, limit=TEXT_BYTES)

    return docs.mapInArrow(run, docs.schema)


def score_texts(docs: DataFrame, network: Network, hold_out: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; texts without words have the bias alone.

    Null and empty texts have no words. Repeated rows all stay. A null doc_id is not held out.
    Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            score = _scores(shared.value, chunk.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "score": pa.array(score, pa.float64()),
                "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    scored = rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
    held = F.coalesce(remainder("doc_id", hold_out) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def fit(docs: DataFrame, labels: DataFrame, hold_out: int = 3) -> Network:
    """A network from a bounded sample of the labelled rows that are not held out.

    Without labelled rows the network is untrained and its scores say nothing.
    """
    learnable = labels.where(remainder("doc_id", hold_out) != 1)
    sample = labelled_sample(
        docs, learnable, F.col("toxic"), {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}, SAMPLE_BYTES)
    rows = sorted(sample.collect(), key=lambda r: r.doc_id)  # SAMPLE_BYTES of text at most
    return train([r.text for r in rows], [r.label for r in rows])
