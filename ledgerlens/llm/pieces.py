"""Operator 2: SentencePiece encoding and decoding by a streaming Viterbi search.

The search maximises the sum of piece scores over a vocabulary file. It goes over the characters
once and keeps, for each boundary within one maximum piece length, the best way to get there. As
soon as the ways to all these boundaries share an earlier boundary, nothing that follows can
change what lies before it: its ids are committed and its state is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow_text import RememberedInBytes, chunks, raw, segments, take_lists

SPACE = "▁"
#: Bytes of text encoded together.
TEXT_BYTES = 4 << 20


class Pieces:
    """Vocabulary of a model file, its streaming encoder and its decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = len(model)
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [model.get_score(i) for i in range(n)]
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                if not model.is_unused(i):
                    self.ids[name] = i
                surface.append(name.replace(SPACE, " ").encode())
        self.surface = pa.array(surface, pa.large_binary())
        self.prefixes = {name[:k]: -1 for name in self.ids for k in range(1, len(name))}
        self.prefixes |= self.ids
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        #: No piece goes on over a space after a visible character: texts fall apart there.
        self.cuts_at_spaces = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.remembered = RememberedInBytes()

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in committed runs. Of equal ways the longer last piece wins.

        The state is a window of boundaries after the last committed one; a text that ends within
        the first window is one run.
        """
        lookup, scores, longest = self.prefixes.get, self.scores, self.longest
        n, window, worst = len(text), 4 * longest, float("-inf")
        base, size = 0, min(n, window + longest)
        best, start, piece = [0.0] + [worst] * size, [0] * (size + 1), [-1] * (size + 1)
        while base < n:
            for at in range(min(n - base, window)):
                here, begin = best[at], base + at
                if here == worst:
                    continue
                single = False
                for end in range(at + 1, min(at + longest, n - base) + 1):
                    i = lookup(text[begin:base + end])
                    if i is None:
                        break
                    if i >= 0:
                        score = here + scores[i]
                        if score > best[end]:
                            best[end], start[end], piece[end] = score, at, i
                        if end == at + 1:
                            single = True
                if not single and here + self.unknown > best[at + 1]:
                    best[at + 1], start[at + 1], piece[at + 1] = here + self.unknown, at, -1
            if n - base <= window:
                yield self._trace(text, base, start, piece, 0, n - base)
                return
            live = [e for e in range(window, min(window + longest, n - base) + 1) if best[e] > worst]
            meet = self._meeting(live, start)
            if meet:
                yield self._trace(text, base, start, piece, 0, meet)
                base += meet
                pad = min(n - base, window + longest) + 1 - (len(best) - meet)
                best = best[meet:] + [worst] * pad
                start = [max(0, x - meet) for x in start[meet:]] + [0] * pad
                piece = piece[meet:] + [-1] * pad
            else:  # the ways have not met yet: look further ahead before the next try
                window *= 2
                pad = min(n - base, window + longest) + 1 - len(best)
                best, start, piece = best + [worst] * pad, start + [0] * pad, piece + [-1] * pad

    @staticmethod
    def _meeting(live: list[int], start: list[int]) -> int:
        """The last boundary on the best ways to all live boundaries."""
        ways = set(live)
        while len(ways) > 1:
            last = max(ways)
            ways.discard(last)
            ways.add(start[last])
        return ways.pop()

    def _trace(self, text: str, base: int, start, piece, begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                bytes_ = text[base + start[end]:base + end].encode()
                out.extend(self.byte_ids[b] for b in reversed(bytes_))
            end = start[end]
        out.reverse()
        return out

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [[i for run in self.stream(v.decode().replace(" ", SPACE)) for i in run]
                 for v in distinct.to_pylist()]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))))
        return bounds, np.fromiter((i for ids in lists for i in ids), np.int32, bounds[-1])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each. A text gets a space in front."""
        led = pc.binary_join_element_wise(
            pc.if_else(pc.equal(pc.binary_length(text), 0), "", " ").cast(text.type), text,
            pa.scalar("", text.type))
        data, offsets = raw(led)
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts_at_spaces:
            spaces = np.flatnonzero(data == 0x20)
            spaces = spaces[spaces > 0]
            b0, b1, b2 = (data[np.maximum(spaces - k, 0)] for k in (1, 2, 3))
            mark = (b0 == 0x81) & (b1 == 0x96) & (b2 == 0xE2)  # the letter that stands for a space
            cut[spaces[(b0 != 0x20) & ~mark]] = True
        array, first = segments(data, offsets, cut)
        coded = array.dictionary_encode()
        bounds, flat = self.remembered.lists(coded.dictionary, self._distinct)
        index = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(np.diff(bounds)[index])))
        return take_lists(bounds, flat, index), np.diff(ends[first])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Bytes of the texts, without the space in front of each."""
        data, ends = raw(self.surface.take(pa.array(ids)))
        bounds = ends[np.concatenate(([0], np.cumsum(lengths)))]
        led = bounds[:-1][bounds[:-1] < bounds[1:]]
        bounds = bounds - np.searchsorted(led, bounds)
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [
            None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.delete(data, led))])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, round_trip: whether decoding gives the text again.

    Every row stays, repeated ones too; null and empty texts have no ids. The letter that stands
    for a space decodes to a space, so a text that holds it itself has round_trip false. Characters
    outside the vocabulary become byte pieces. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            vocabulary, text = pieces(model), chunk.column("text")
            ids, lengths = vocabulary.encode(text)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            same = pc.equal(vocabulary.decode(ids, lengths), text.cast(pa.large_binary()))
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out = pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "n_tokens": pa.array(lengths),
                "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)),
                "ids_crc32": pa.array(crc, pa.int64()), "round_trip": same})
            for begin in range(0, out.num_rows, 2000):
                yield out.slice(begin, 2000)

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, "
                                "ids_crc32 bigint, round_trip boolean")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text.

    Bytes that are no UTF-8 become the replacement character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            texts = pieces(model).decode(flat, lengths.astype(np.int64)).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())})

    rows = encoded.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(ids AS array<int>) AS ids")
    return rows.mapInArrow(run, "doc_id bigint, text string")
