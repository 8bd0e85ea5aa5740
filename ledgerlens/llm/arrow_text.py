"""Arrow batches of texts inside tasks: bounded chunks, words, segments and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one task handles at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 8 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut or put together to about ``limit`` bytes of text, null texts made empty."""
    held, held_bytes = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, pa.field(column, pa.large_string()), text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = int(np.searchsorted(ends, before + limit - held_bytes, side="right"))
            stop = min(batch.num_rows, max(stop, begin + (not held)))
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                held_bytes += int(ends[stop - 1] - before)
                begin = stop
            if begin < batch.num_rows:
                yield _joined(held)
                held, held_bytes = [], 0
    if held:
        yield _joined(held)
    held.clear()
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system: a worker waits for its next task beside others at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def kept_rows(batches: Iterator[pa.RecordBatch], dropped, column: str = "text",
              limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Whole rows of batches, less those for which ``dropped`` (texts to booleans) is true."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        number = pa.array(np.arange(batch.num_rows))
        for chunk in chunks(iter([pa.RecordBatch.from_arrays([number, text], ["row", column])]), column, limit):
            gone = dropped(chunk.column(column))
            yield batch.take(chunk.column("row").filter(pa.array(~gone)))


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string or large_binary array."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


class Words(NamedTuple):
    index: np.ndarray      # of every word, its place in vocabulary
    vocabulary: pa.Array   # the chunk's distinct words
    offsets: np.ndarray    # of every text, its first word; one more at the end


def words(text: pa.Array, lower: bool = True) -> Words:
    """Words between ASCII white space, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(
        pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    vocabulary = coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:  # white space at either end of a text leaves an empty word
        real = index != empty
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        index = index[real]
        index -= index > empty
        vocabulary = vocabulary.filter(pa.array(np.arange(len(vocabulary)) != empty))
    return Words(index, vocabulary, offsets)


def string_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.to_pylist()), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each place; the last ``size - 1`` are missing."""
    n = len(hashes) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX + hashes[k:k + n])
    return out


def segments(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before the marked bytes: the segments, and each text's first segment."""
    cut = cut.copy()
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[begins] = True
    starts = np.flatnonzero(cut[:offsets[-1]])
    starts = starts[starts >= offsets[0]]
    bounds = np.append(starts, offsets[-1]).astype(np.int64)
    array = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return array, np.searchsorted(starts, offsets)


def take_lists(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenation of values[offsets[i]:offsets[i + 1]] for i in index."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values))
    return lists.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False)


class Remembered:
    """Number lists of distinct segments, kept between the chunks of a Python worker."""

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self._keep(pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def _keep(self, values: pa.Array, bounds: np.ndarray, numbers: np.ndarray) -> None:
        self.values, self.bounds, self.numbers = values, bounds, numbers

    def lists(self, distinct: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and numbers; ``make`` gives those of the segments that are not yet known."""
        at = pc.index_in(distinct, value_set=self.values)
        new = pc.is_null(at)
        fresh = distinct.filter(new)
        new = new.to_numpy(zero_copy_only=False)
        where = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        where[new] = len(self.values) + np.arange(len(fresh))
        bounds, numbers = self.bounds, self.numbers
        values = self.values
        if len(fresh):
            more, found = make(fresh)
            bounds = np.concatenate((bounds, bounds[-1] + more[1:]))
            numbers = np.concatenate((numbers, found.astype(np.int32)))
            values = pa.concat_arrays([values, fresh])
        sizes = np.diff(bounds)[where]
        out = np.concatenate(([0], np.cumsum(sizes))), take_lists(bounds, numbers, where)
        if len(values) <= self.limit:
            self._keep(values, bounds, numbers)
        else:
            self._keep(distinct, *out)
        return out


class RememberedInBytes:
    """Number lists of distinct segments, kept between the chunks of a Python worker.

    What is kept is bounded in bytes, an allowance for each entry included, and begun anew beyond.
    """

    def __init__(self, limit: int = 160 << 20, entry: int = 170):
        self.limit, self.entry, self.held = limit, entry, 0
        self.known: dict[bytes, bytes] = {}

    def lists(self, distinct: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and numbers; ``make`` gives those of the segments that are not yet known."""
        keys = distinct.to_pylist()
        new = [key for key in keys if key not in self.known]
        if new:
            bounds, numbers = make(pa.array(new, distinct.type))
            numbers = numbers.astype(np.int32)
            for key, begin, end in zip(new, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                self.known[key] = numbers[begin:end].tobytes()
                self.held += len(key) + 4 * (end - begin) + self.entry
        found = [self.known[key] for key in keys]
        if self.held > self.limit:
            self.known, self.held = {}, 0
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(found), np.int32)
