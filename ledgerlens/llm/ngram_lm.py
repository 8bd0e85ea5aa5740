"""Operator 8: language-model scoring by Elias-Fano n-gram tries of order two or three.

The model is absolute discounting over add-one unigrams,
    p(w | u v) = max(c(u v w) - D, 0) / c(u v) + mass(u v) * p(w | v),
    p(w | v) = max(c(v w) - D, 0) / c(v) + mass(v) * p(w),     p(w) = (c(w) + 1) / (N + V + 1),
with one end token after each text, which is also the context of a text's first words. A context
that training lacks has the mass one. Grams of two and three words seen at most ``prune`` times
in training leave the trie and give their share to the mass, so it stays a distribution.

The corpus is tokenised once, in chunks. A chunk sends each shard of the hashes of the words before
a word its distinct words, contexts and grams with their training counts: one shuffle of data that is
already counted. A shard adds up what all chunks sent, builds its trie and answers every chunk with
codes; the answers meet the chunk's tokens again and give each text its sums. A trie has word hashes
with pointers into two second levels, the successors of each word and the words before it; each of
the latter is a context of two words with pointers into the third level. There a successor is its
place among the successors of the context's last word, which is a small number. Children are made
ascending over all parents, and have 8-bit codes of discounted probabilities and masses. Levels are
Elias-Fano sequences in one array that is memory-mapped while it is queried.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow_text import chunks, string_hashes, words
from .elias_fano import EliasFano
from .word_features import remainder

DISCOUNT = 0.75
#: Grams seen at most so often in training are left to the mass.
PRUNE = 1
#: Bits of a word relative to the one before or after it.
SUCCESSOR_BITS = 32
LOW = np.uint64((1 << SUCCESSOR_BITS) - 1)
CHUNK_BYTES = 8 << 20
#: Tokens for each shard.
SHARD_TOKENS = 1_500_000
#: Hash of the end token: a word that no text can hold.
END = int(string_hashes(pa.array(["\n"]))[0])
CODES = 255


def _packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


class Codebook:
    """8-bit codes of probabilities: bins of equal numbers of values, 0 for none."""

    @staticmethod
    def make(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes from 1, and the centre of each code's bin (log10)."""
        logs = np.log10(np.maximum(values, 1e-12))
        distinct = np.unique(logs)
        if len(distinct) <= CODES:
            return (np.searchsorted(distinct, logs) + 1).astype(np.uint8), distinct
        edges = np.unique(np.quantile(logs, np.linspace(0, 1, CODES + 1)[1:-1]))
        codes = np.searchsorted(edges, logs, side="right")
        sums = np.bincount(codes, logs, len(edges) + 1)
        n = np.bincount(codes, minlength=len(edges) + 1)
        return (codes + 1).astype(np.uint8), sums / np.maximum(1, n)


def _joint(parent: np.ndarray, child: np.ndarray, bits: int = SUCCESSOR_BITS) -> np.ndarray:
    return parent.astype(np.uint64) << np.uint64(bits) | child.astype(np.uint64)


def _pointers(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Trie:
    """Read-only trie over a memory-mapped array of 64-bit words."""

    LEVELS = ("words", "successor_pointers", "successors", "context_pointers", "contexts", "gram_pointers", "grams")
    BOOKS = ("mass", "pair", "context", "gram")

    def __init__(self, memory: np.ndarray):
        self.base, self.rank_bits, at = memory[0], int(memory[1]), 2
        for name in self.LEVELS:
            level, at = EliasFano.at(memory, at)
            setattr(self, name, level)

        def field(kind, length: int) -> np.ndarray:
            nonlocal at
            size = -(-length * np.dtype(kind).itemsize // 8)
            out = memory[at:at + size].view(kind)[:length]
            at += size
            return out

        # value 0 of a book is what holds where there is no code: all the mass, no probability
        self.books = [field(np.float64, CODES + 1) for _ in self.BOOKS]
        levels = (self.words, self.successors, self.contexts, self.grams)
        self.codes = [field(np.uint8, level.n) for level in levels]

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, contexts: np.ndarray, grams: np.ndarray, pairs: np.ndarray,
              pair: np.ndarray, totals: np.ndarray, order: int, prune: int, discount: float) -> np.ndarray:
        """Array of a trie. ``contexts`` are ascending (word, word before it), ``grams`` ascending
        (context, successor) with their counts in training, ``pairs`` ascending (word, successor) and ``pair``
        that of each gram; words are places in the ascending ``hashes``."""
        known = np.flatnonzero(counts)  # the trie holds words of training alone
        number = np.full(len(hashes), -1)
        number[known] = np.arange(len(known))
        hashes, counts, n = hashes[known], counts[known], len(known)
        node = number[(contexts >> np.uint64(32)).astype(np.int64)]  # -1 only where nothing was learnt
        context = (grams >> np.uint64(32)).astype(np.int64)

        pair_counts = np.bincount(pair, totals, len(pairs)).astype(np.int64)
        word = number[(pairs >> np.uint64(32)).astype(np.int64)]
        kept = pair_counts > prune
        lost = (pair_counts > 0) & ~kept
        types = np.bincount(word[kept], minlength=n)
        mass = (discount * types + np.bincount(word[lost], pair_counts[lost], n)) / np.maximum(1, counts)
        place = np.cumsum(kept) - 1  # of each pair among those that are kept
        pairs, word, pair_counts = pairs[kept], word[kept], pair_counts[kept]
        pointers = _pointers(types)

        # of grams that are kept the pairs are kept too
        deep = np.flatnonzero(totals > prune) if order > 2 else np.zeros(0, np.int64)
        whole = np.bincount(context, totals, len(contexts))
        gram_types = np.bincount(context[deep], minlength=len(contexts))
        stored = np.flatnonzero(gram_types)
        told = np.bincount(context[deep], totals[deep], len(contexts))
        left = (discount * gram_types + whole - told)[stored] / whole[stored]
        at = np.zeros(len(contexts), np.int64)
        at[stored] = np.arange(len(stored))
        rank = place[pair[deep]] - pointers[node[context[deep]]]
        rank_bits = int(types.max() if n else 0).bit_length()

        parts = [np.array([hashes[0] if n else 0, rank_bits], np.uint64)]
        for values in (hashes - parts[0][0], pointers, _joint(word, pairs & LOW),
                       _pointers(np.bincount(node[stored], minlength=n)), _joint(node[stored], contexts[stored] & LOW),
                       _pointers(gram_types[stored]), _joint(at[context[deep]], rank, rank_bits)):
            parts += EliasFano.encode(values).parts()
        values = (mass, (pair_counts - discount) / counts[word], left, (totals[deep] - discount) / whole[context[deep]])
        coded = [Codebook.make(v) for v in values]
        for (_, book), none in zip(coded, (1.0, 0.0, 1.0, 0.0), strict=True):
            parts.append(np.concatenate(([none], 10.0 ** book, np.zeros(CODES - len(book)))))
        parts += [codes for codes, _ in coded]
        padded = [np.frombuffer(p.tobytes() + b"\0" * (-p.nbytes % 8), np.uint64) for p in parts]
        return np.concatenate(padded)

    def nodes(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the first level, -1 where they are not."""
        n = len(hashes)
        relative = hashes - self.base
        inside = hashes >= self.base
        at = self.words.find(np.where(inside, relative, 0), np.zeros(n), np.full(n, self.words.n))
        found = inside & (at < self.words.n)
        found[found] = self.words.get(at[found]) == relative[found]
        return np.where(found, at, -1)

    @staticmethod
    def _children(pointers: EliasFano, level: EliasFano, parent: np.ndarray, child: np.ndarray,
                  bits: int = SUCCESSOR_BITS) -> np.ndarray:
        """Places of children, searched within their parent's part of the level; -1 where they are not."""
        out = np.full(len(parent), -1)
        real = np.flatnonzero(parent >= 0)
        parent = parent[real]
        begin, end = pointers.get(parent).astype(np.int64), pointers.get(parent + 1).astype(np.int64)
        wanted = _joint(parent, child[real], bits)
        at = level.find(wanted, begin, end)
        inside = at < end
        inside[inside] = level.get(at[inside]) == wanted[inside]
        out[real[inside]] = at[inside]
        return out

    def look_up(self, hashes: np.ndarray, contexts: np.ndarray, grams: np.ndarray, pairs: np.ndarray,
                pair: np.ndarray) -> list[np.ndarray]:
        """Codes of words, of the pairs in grams, of contexts and of grams; laid out as for ``build``."""
        node = self.nodes(hashes)
        word = (contexts >> np.uint64(32)).astype(np.int64)
        context = (grams >> np.uint64(32)).astype(np.int64)
        owner = node[(pairs >> np.uint64(32)).astype(np.int64)]
        successor = self._children(self.successor_pointers, self.successors, owner, pairs & LOW)
        before = self._children(self.context_pointers, self.contexts, node[word], contexts & LOW) \
            if self.contexts.n else np.full(len(contexts), -1)
        first = np.zeros(len(owner), np.int64)
        first[owner >= 0] = self.successor_pointers.get(owner[owner >= 0])
        rank, parent = (successor - first)[pair], before[context]
        parent = np.where(successor[pair] >= 0, parent, -1)
        gram = self._children(self.gram_pointers, self.grams, parent, rank, self.rank_bits)
        found = (node, successor, before, gram)
        coded = [np.append(codes, np.uint8(0))[places] for codes, places in zip(self.codes, found, strict=True)]
        coded[1] = coded[1][pair]
        return coded


def mapped(memory: np.ndarray) -> np.ndarray:
    """The array as a memory-mapped file without a name: it goes with the task."""
    handle, path = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(memory.tobytes())
        return np.memmap(path, np.uint64, "r")
    finally:
        os.unlink(path)


TOKENS = ("batch bigint, doc_ids array<bigint>, training array<boolean>, lengths array<bigint>, "
          "vocabulary binary, tokens binary, n_tokens bigint")


def token_chunks(docs: DataFrame) -> DataFrame:
    """Tokens of chunks of texts, as places in the chunk's ascending word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            found = words(chunk.column("text"))
            hashes = np.append(string_hashes(found.vocabulary), np.uint64(END))
            vocabulary, place = np.unique(hashes, return_inverse=True)
            tokens = np.insert(place[found.index], found.offsets[1:], place[-1]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([number], pa.int64()),
                "doc_ids": pa.array([chunk.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "training": pa.array([chunk.column("training").to_pylist()], pa.list_(pa.bool_())),
                "lengths": pa.array([np.diff(found.offsets) + 1], pa.list_(pa.int64())),
                "vocabulary": pa.array([_packed(vocabulary)], pa.binary()),
                "tokens": pa.array([_packed(tokens)], pa.binary()),
                "n_tokens": pa.array([len(tokens)], pa.int64())})
            number += 1

    return docs.mapInArrow(run, TOKENS)


def _grams_of(row: dict, order: int):
    """Vocabulary, token places, lengths, training marks; contexts, grams and each token's gram.

    A context is the word before a token with the one before that (none for order two), a gram is
    a context's place with the token.
    """
    vocabulary = _unpacked(row["vocabulary"], np.uint64)
    tokens = _unpacked(row["tokens"], np.int32).astype(np.int64)
    lengths = np.array(row["lengths"], np.int64)
    end = int(np.searchsorted(vocabulary, np.uint64(END)))
    before = np.append(end, tokens[:-1])  # the end of a text is the context of the next one
    earlier = np.zeros(len(tokens), np.int64)
    if order > 2:
        earlier = np.append([end, end], tokens)[:len(tokens)]
        earlier[np.cumsum(lengths) - lengths] = end  # nothing of the text before
    training = np.repeat(np.array(row["training"], bool), lengths)
    contexts, context = np.unique(before << 32 | earlier, return_inverse=True)
    grams, gram = np.unique(context << 32 | tokens, return_inverse=True)
    return vocabulary, tokens, lengths, training, contexts, grams, gram


def _shard_bounds(n_shards: int) -> np.ndarray:
    return np.array([(k << 64) // n_shards for k in range(1, n_shards)], np.uint64)


SENT = ("shard int, batch bigint, words binary, counts binary, contexts binary, earlier binary, grams binary, "
        "successors binary, gram_counts binary")
ANSWERS = ("batch bigint, shard int, word_counts binary, masses binary, pairs binary, contexts binary, grams binary, "
           "books binary, n_tokens bigint, n_words bigint")
CODED = ("masses", "pairs", "contexts", "grams")


def _sent(tokens: DataFrame, n_shards: int, order: int) -> DataFrame:
    bounds = _shard_bounds(n_shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, token, _, training, contexts, grams, gram = _grams_of(row, order)
                counts = np.bincount(token[training], minlength=len(vocabulary))
                gram_counts = np.bincount(gram[training], minlength=len(grams))
                short = (vocabulary >> np.uint64(64 - SUCCESSOR_BITS)).astype(np.uint32)
                word, context = contexts >> 32, grams >> 32
                earlier, successor = short[contexts & 0xFFFFFFFF], short[grams & 0xFFFFFFFF]
                if order < 3:
                    earlier = np.zeros(len(contexts), np.uint32)
                word_edges = np.concatenate(([0], np.searchsorted(vocabulary, bounds), [len(vocabulary)]))
                context_edges = np.searchsorted(word, word_edges)
                gram_edges = np.searchsorted(context, context_edges)
                per_word = np.bincount(word, minlength=len(vocabulary))
                per_context = np.bincount(context, minlength=len(contexts))
                for k in np.flatnonzero(np.diff(word_edges)).tolist():
                    w, c, g = (slice(edges[k], edges[k + 1]) for edges in (word_edges, context_edges, gram_edges))
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([k], pa.int32()), "batch": pa.array([row["batch"]], pa.int64()),
                        "words": pa.array([vocabulary[w].tobytes()], pa.binary()),
                        "counts": pa.array([_packed(counts[w].astype(np.uint32))], pa.binary()),
                        "contexts": pa.array([_packed(per_word[w].astype(np.uint32))], pa.binary()),
                        "earlier": pa.array([_packed(earlier[c])], pa.binary()),
                        "grams": pa.array([_packed(per_context[c].astype(np.uint32))], pa.binary()),
                        "successors": pa.array([_packed(successor[g])], pa.binary()),
                        "gram_counts": pa.array([_packed(gram_counts[g].astype(np.uint32))], pa.binary())})

    return tokens.mapInArrow(run, SENT)


def _answers(sent: DataFrame, n_shards: int, order: int, prune: int) -> DataFrame:
    """Every shard's trie, queried for every chunk that has words in it."""

    def answer(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        def all_of(name: str) -> tuple[np.ndarray, np.ndarray]:
            """A column of all chunks, and where each chunk's part begins and ends."""
            parts = [np.frombuffer(r[name], np.uint64) if name == "words" else _unpacked(r[name], np.uint32) for r in rows]
            return np.concatenate(parts), _pointers(np.array([len(p) for p in parts]))

        words, word_bounds = all_of("words")
        hashes, place = np.unique(words, return_inverse=True)
        counts = np.bincount(place, all_of("counts")[0], len(hashes)).astype(np.int64)
        earlier, context_bounds = all_of("earlier")
        contexts, context = np.unique(_joint(np.repeat(place, all_of("contexts")[0]), earlier), return_inverse=True)
        successors, gram_bounds = all_of("successors")
        grams, gram = np.unique(_joint(np.repeat(context, all_of("grams")[0]), successors), return_inverse=True)
        del words, earlier, successors
        totals = np.bincount(gram, all_of("gram_counts")[0], len(grams)).astype(np.int64)
        owner = (contexts >> np.uint64(32))[(grams >> np.uint64(32)).astype(np.int64)]
        pairs, pair = np.unique(_joint(owner, grams & LOW), return_inverse=True)
        del owner
        trie = Trie(mapped(Trie.build(hashes, counts, contexts, grams, pairs, pair, totals, order, prune, DISCOUNT)))
        del totals
        mass, pair, before, deep = trie.look_up(hashes, contexts, grams, pairs, pair)
        books = _packed(np.array(trie.books, np.float64))
        for k, row in enumerate(rows):
            w, c, g = (at[bounds[k]:bounds[k + 1]] for at, bounds in (
                (place, word_bounds), (context, context_bounds), (gram, gram_bounds)))
            coded = {"masses": mass[w], "pairs": pair[g], "contexts": before[c], "grams": deep[g]}
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([row["batch"]], pa.int64()), "shard": pa.array([shard], pa.int32()),
                "word_counts": pa.array([_packed(counts[w])], pa.binary()),
                **{name: pa.array([_packed(coded[name])], pa.binary()) for name in CODED},
                "books": pa.array([books], pa.binary()),
                "n_tokens": pa.array([int(counts.sum()) if k == 0 else 0], pa.int64()),
                "n_words": pa.array([int(np.count_nonzero(counts)) if k == 0 else 0], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[-1]["shard"] != row["shard"]:
                    yield from answer(rows[-1]["shard"], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from answer(rows[-1]["shard"], rows)

    ordered = sent.repartition(n_shards, "shard").sortWithinPartitions("shard", "batch")
    return ordered.mapInArrow(run, ANSWERS)


RESULT = ("doc_id bigint, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def score_texts(docs: DataFrame, training, order: int = 2, prune: int = PRUNE) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from the rows for which the column ``training`` holds. base_score is the
    add-one unigram model's log10 probability, score that of the model of ``order`` two or three, without
    grams seen at most ``prune`` times. Null and empty texts are an end token alone. Repeated rows all stay. Without training rows all counts are zero.
    Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("training"))
    tokens = materialize(token_chunks(rows), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, math.ceil(total / SHARD_TOKENS))
    sent = _sent(tokens, n_shards, order)
    answers = materialize(_answers(sent, n_shards, order, prune), "answers")
    learnt, distinct = answers.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    learnt, distinct = learnt or 0, distinct or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, token, lengths, _, contexts, grams, gram = _grams_of(row, order)
                parts = sorted(row["answers"], key=lambda a: a["shard"])
                counts = np.concatenate([_unpacked(a["word_counts"], np.int64) for a in parts])
                books = [_unpacked(a["books"], np.float64).reshape(len(CODED), -1) for a in parts]
                mass, pair, left, deep = (
                    np.concatenate([book[k][_unpacked(a[name], np.uint8)] for a, book in zip(parts, books, strict=True)])
                    for k, name in enumerate(CODED))
                base = (counts + 1) / (learnt + distinct + 1)
                context, word = grams >> 32, grams & 0xFFFFFFFF
                log_gram = np.log10(deep + left[context] * (pair + mass[contexts >> 32][context] * base[word]))
                single = np.log10(base)
                first = np.cumsum(lengths) - lengths
                n = len(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "training": pa.array(row["training"], pa.bool_()), "n_tokens": pa.array(lengths),
                    "n_known": pa.array(np.add.reduceat((counts > 0)[token].astype(np.int64), first)),
                    "train_tokens": pa.array([learnt] * n, pa.int64()),
                    "base_score": pa.array(np.add.reduceat(single[token], first)),
                    "score": pa.array(np.add.reduceat(log_gram[gram], first))})

    answered = answers.groupBy("batch").agg(F.collect_list(
        F.struct("shard", "word_counts", *CODED, "books")).alias("answers"))
    return tokens.join(answered, "batch").mapInArrow(run, RESULT)


def held_out_scores(
    docs: DataFrame, modulus: int = 7, remainder_: int = 2, *, order: int = 2, prune: int = PRUNE,
) -> DataFrame:
    """Scores by a model of the rows whose crc32(doc_id) modulo ``modulus`` is another remainder.

    A null doc_id is neither learnt from nor held out.
    """
    held = remainder("doc_id", modulus) == remainder_
    scored = score_texts(docs, ~held, order, prune)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")
