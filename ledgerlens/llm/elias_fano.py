"""Elias-Fano coding of ascending integers: compact, read in place, many places at once."""

from __future__ import annotations

import numpy as np

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_BYTE_SELECT = np.array([[[i for i in range(8) if b >> i & 1] + [0] * 8][0][:8] for b in range(256)], np.uint8)
U = np.uint64
#: Places are read one by one where fewer than one in so many are asked for; else the whole sequence is.
SPARSE = 8


class EliasFano:
    """Values split in ``low_bits`` packed bits and a bitmap of the rest in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _BYTE_ONES[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))  # ones before each word

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.ascontiguousarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            kept = values & U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, kept << shift)
            over = np.flatnonzero(shift + U(low_bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, kept[over] >> (U(64) - shift[over]))
        place = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(np.uint64))
        return cls(n, low_bits, low, high)

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the places ``index``."""
        index = np.asarray(index, np.int64)
        if self._many(index):
            return self.all()[index]
        word = np.searchsorted(self.before, index, side="right") - 1
        rest = (index - self.before[word]).astype(np.int64)
        bits = self.high[word]
        place = word << 6
        for _ in range(8):  # byte by byte to the one with the wanted bit
            ones = _BYTE_ONES[(bits & U(255)).astype(np.int64)]
            skip = rest >= ones
            if not skip.any():
                break
            rest = np.where(skip, rest - ones, rest)
            bits = np.where(skip, bits >> U(8), bits)
            place = place + 8 * skip
        place = place + _BYTE_SELECT[(bits & U(255)).astype(np.int64), rest]
        return self._with_low((place - index).astype(np.uint64), index)

    def all(self) -> np.ndarray:
        """All values, in one pass over the bits."""
        index = np.arange(self.n)
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool))
        return self._with_low((place - index).astype(np.uint64), index)

    def _many(self, asked: np.ndarray) -> bool:
        return len(asked) * SPARSE > self.n

    def _with_low(self, high: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Values of their high parts and places."""
        out = high << U(self.low_bits)
        if self.low_bits:
            at = index * self.low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            low = self.low[word] >> shift
            over = shift > 0
            low = np.where(over, low | (self.low[word + 1] << np.where(over, U(64) - shift, U(0))), low)
            out |= low & U((1 << self.low_bits) - 1)
        return out

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place in [begin, end) with a value of at least the wanted one; end if there is none."""
        low, high = np.array(begin, np.int64), np.array(end, np.int64)
        if self._many(values):  # the sequence ascends, so a part's first place is the whole's, within the part
            return np.maximum(low, np.minimum(high, np.searchsorted(self.all(), values)))
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.get(middle) < values[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return low

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.uint64), self.low, self.high]

    @classmethod
    def at(cls, words: np.ndarray, begin: int) -> tuple["EliasFano", int]:
        """The sequence that starts at a place of a (memory-mapped) array of words; its end."""
        n, low_bits, n_low, n_high = (int(x) for x in words[begin:begin + 4])
        middle = begin + 4 + n_low
        return cls(n, low_bits, words[begin + 4:middle], words[middle:middle + n_high]), middle + n_high
