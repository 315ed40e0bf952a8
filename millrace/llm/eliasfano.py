"""Elias-Fano sequences over 64-bit words, searched for many keys at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_HALVES = [(_U(s), _U((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary.

    ``parts`` are plain arrays, so a sequence can lie in a memory-mapped file.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - ones.astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` (uint64) are below ``universe``."""
        n = len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        at = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.uint64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            v = values & _U((1 << width) - 1)
            bit = np.arange(n, dtype=np.uint64) * _U(width)
            word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
            np.bitwise_or.at(low, word, v << shift)
            over = np.flatnonzero(shift + _U(width) > _U(64))
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (_U(64) - shift[over]))
        return cls(n, width, low, high, np.cumsum(count, dtype=np.uint64) - count)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.uint64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * _U(self.width)
        word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        up = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | up) & _U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        before = self.ones if ones else self.zeros
        w = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        word = self.high[w] if ones else ~self.high[w]
        rest = (k - before[w].astype(np.int64)).astype(np.int64)
        pos = w * 64
        for s, mask in _HALVES:
            c = np.bitwise_count(word & mask).astype(np.int64)
            go = rest >= c
            rest -= np.where(go, c, 0)
            pos = pos + np.where(go, int(s), 0)
            word = np.where(go, word >> s, word)
        return pos

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, by successor search; -1 where it is absent."""
        hx = (x >> _U(self.width)).astype(np.int64)
        lx = x & _U((1 << self.width) - 1)
        i = np.where(hx > 0, self._select(np.maximum(hx - 1, 0), False) + 1, 0) - hx
        end = self._select(hx, False) - hx
        last = end.copy()
        while True:  # binary search among the values of equal high bits
            live = np.flatnonzero(i < end)
            if not len(live):
                break
            mid = (i[live] + end[live]) >> 1
            less = self._low(mid) < lx[live]
            i[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(i < last)
        some = some[self._low(i[some]) == lx[some]]
        out[some] = i[some]
        return out
