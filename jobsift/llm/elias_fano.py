"""Elias-Fano coding of non-decreasing integers, read in place with numpy.

Each value is split: the low bits are packed side by side; the high parts are written as
a bit vector with a one for each value and a zero after each high part. A directory of
zeros before each 64-bit word finds any bucket. About ``2 + log2(universe / n)`` bits a
value. Reading works on vectors of positions or values, over a buffer that may be a
memory-mapped file: nothing is unpacked.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_HEAD = struct.Struct("<QQQQ")


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the ``rank``-th set bit (from 0) in each 64-bit word."""
    at = np.zeros(len(words), dtype=np.uint64)
    rank = rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words >> at & _U((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rank >= ones
        rank = rank - np.where(up, ones, 0)
        at = at + np.where(up, _U(width), _U(0))
    return at.astype(np.int64)


class EliasFano:
    """A coded sequence over a bytes-like buffer made by ``build``."""

    def __init__(self, buffer, offset: int = 0):
        self.n, self.low_bits, n_words, n_low = _HEAD.unpack_from(buffer, offset)
        at = offset + _HEAD.size
        self.words = np.frombuffer(buffer, "<u8", n_words, at)
        at += 8 * n_words
        self.zeros = np.frombuffer(buffer, "<u8", n_words + 1, at)
        at += 8 * (n_words + 1)
        self.ones = np.arange(0, 64 * (n_words + 1), 64) - self.zeros.astype(np.int64)
        packed = np.frombuffer(buffer, np.uint8, n_low, at)
        self.lows = np.ndarray((max(0, n_low - 7),), "<u8", packed, strides=(1,)) if n_low else packed
        self.end = at + n_low

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values must not decrease")
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> _U(low_bits)).astype(np.int64)
        size = (n + (int(high[-1]) if n else 0) + 2 + 63) // 64 * 64
        bits = np.zeros(size, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64)))).astype("<u8")
        low = np.zeros((n * low_bits + 7) // 8, dtype=np.uint8)
        if low_bits:
            step = 1 << 16
            parts = []
            for a in range(0, n, step):
                part = values[a : a + step] & _U((1 << low_bits) - 1)
                parts.append((part[:, None] >> np.arange(low_bits, dtype=np.uint64) & _U(1)).astype(np.uint8).ravel())
            low = np.packbits(np.concatenate(parts), bitorder="little") if parts else low
        low = np.concatenate((low, np.zeros(8, dtype=np.uint8)))
        pad = -(len(low)) % 8
        low = np.concatenate((low, np.zeros(pad, dtype=np.uint8)))
        return _HEAD.pack(n, low_bits, len(words), len(low)) + words.tobytes() + zeros.tobytes() + low.tobytes()

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        bit = index.astype(np.int64) * self.low_bits
        return self.lows[bit >> 3] >> (bit & 7).astype(np.uint64) & _U((1 << self.low_bits) - 1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at positions."""
        index = np.asarray(index, dtype=np.int64)
        word = np.searchsorted(self.ones, index, side="right") - 1
        place = word * 64 + _select(self.words[word], index - self.ones[word])
        return ((place - index).astype(np.uint64) << _U(self.low_bits)) | self._low(index)

    def _bucket_end(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most ``high``."""
        word = np.searchsorted(self.zeros, high.astype(np.uint64), side="right") - 1
        word = np.minimum(word, len(self.words) - 1)
        inside = high - self.zeros[word].astype(np.int64)
        return word * 64 + _select(~self.words[word], inside) - high

    def find(self, value: np.ndarray) -> np.ndarray:
        """Position of the first value not less than each given one (the successor)."""
        value = np.asarray(value, dtype=np.uint64)
        if self.n == 0:
            return np.zeros(len(value), dtype=np.int64)
        top = int(self.get(np.array([self.n - 1]))[0])
        beyond = value > _U(top)
        value = np.minimum(value, _U(top))
        high = (value >> _U(self.low_bits)).astype(np.int64)
        low = value & _U((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._bucket_end(np.maximum(high - 1, 0)), 0)
        end = self._bucket_end(high)
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            middle = (start[open_] + end[open_]) // 2
            less = self._low(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        return np.where(beyond, self.n, start)

    def index(self, value: np.ndarray) -> np.ndarray:
        """Position of the first value equal to each given one, -1 where there is none.

        As ``find``, but a high part's values are counted as the ones behind its first.
        """
        value = np.asarray(value, dtype=np.uint64)
        out = np.full(len(value), -1, dtype=np.int64)
        high = value >> _U(self.low_bits)
        # there are as many zeros as high parts, and some more
        some = np.flatnonzero(high < _U(64 * len(self.words) - self.n)) if self.n else []
        if not len(some):
            return out
        high, low = high[some].astype(np.int64), value[some] & _U((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._bucket_end(np.maximum(high - 1, 0)), 0)
        at = start + high                                   # the bit where the bucket begins
        word, off = at >> 6, (at & 63).astype(np.uint64)
        bits = self.words[word] >> off
        bits |= np.where(off > 0, self.words[np.minimum(word + 1, len(self.words) - 1)] << ((_U(64) - off) & _U(63)), _U(0))
        ones = np.bitwise_count(bits & ~(bits + _U(1))).astype(np.int64)
        full = np.flatnonzero(ones == 64)
        end = start + ones
        end[full] = self._bucket_end(high[full])
        until = end.copy()
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            middle = (start[open_] + end[open_]) // 2
            less = self._low(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        met = np.flatnonzero(start < until)
        met = met[self._low(start[met]) == low[met]]
        out[some[met]] = start[met]
        return out

    def size(self) -> int:
        return self.words.nbytes + self.zeros.nbytes + (len(self.lows) + 7 if self.low_bits else 0)
