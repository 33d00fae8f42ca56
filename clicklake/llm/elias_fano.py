"""Sorted sets of 64-bit fingerprints in Elias-Fano form."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

U = np.uint64


def _bits_of(words: np.ndarray) -> np.ndarray:
    """A row of 64 bits, lowest first, for each word."""
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class EliasFano:
    """Sorted distinct keys under 2^bits: the high part of each in unary, the low part in as many bits as it needs.

    In the unary vector the keys with high part v are ones before the v-th zero. A count of zeros before every word makes
    select quick and costs one bit a key; all in all a key takes about 3 + bits - log2(keys) bits.
    """

    def __init__(self, keys: np.ndarray, bits: int = 64):
        keys = np.asarray(keys, U)
        self._room(len(keys), int(keys[-1]) if len(keys) else 0, bits)
        self._write(keys, 0)
        self._index()

    @classmethod
    def of(cls, blocks: Iterable[np.ndarray], n: int, last: int, bits: int = 64) -> EliasFano:
        """The set of n keys that come in sorted blocks, the greatest being `last`; no more than a block is ever plain."""
        self, at = cls.__new__(cls), 0
        self._room(n, last, bits)
        for keys in blocks:
            self._write(keys, at)
            at += len(keys)
        self._index()
        return self

    def _room(self, n: int, last: int, bits: int) -> None:
        self.n, self.bits, self.last = n, bits, last
        self.low_bits = max(0, bits - max(1, int(n).bit_length()))
        self.upper = np.zeros((n + (last >> self.low_bits) + 1 + 63) // 64 + 1, U)
        self.lower = np.zeros((n * self.low_bits) // 64 + 2, U)

    def _write(self, keys: np.ndarray, first: int) -> None:
        """Keys number first, first + 1, ..."""
        at = np.arange(first, first + len(keys), dtype=np.int64)
        high = (keys >> U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(keys), np.int64)
        one = high + at
        np.bitwise_or.at(self.upper, one >> 6, U(1) << (one & 63).astype(U))
        if self.low_bits:
            low = keys & self._mask()
            at = at * self.low_bits
            word, off = at >> 6, (at & 63).astype(U)
            np.bitwise_or.at(self.lower, word, low << off)
            over = (at & 63) + self.low_bits > 64
            np.bitwise_or.at(self.lower, word[over] + 1, low[over] >> (U(64) - off[over]))

    def _index(self) -> None:
        zeros = 64 - np.bitwise_count(self.upper).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)[:-1]])

    def _mask(self) -> np.uint64:
        return U((1 << self.low_bits) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(U)
        rest = np.where(off > 0, self.lower[word + 1] << ((U(64) - off) & U(63)), U(0))
        return ((self.lower[word] >> off) | rest) & self._mask()

    def _up_to(self, v: np.ndarray) -> np.ndarray:
        """How many keys have a high part of at most v: the place of the v-th zero, less v; all beyond the last zero."""
        out = np.full(len(v), self.n, np.int64)
        out[v < 0] = 0
        word = np.searchsorted(self.zeros, v, side="right") - 1
        inside = (v >= 0) & (v < self.zeros[-1] + 64 - int(np.bitwise_count(self.upper[-1])))
        w, k = word[inside], v[inside]
        bits = _bits_of(~self.upper[w])
        place = np.argmax(np.cumsum(bits, axis=1, dtype=np.int16) == (k - self.zeros[w] + 1)[:, None], axis=1)
        out[inside] = np.minimum(w * 64 + place - k, self.n)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first key >= x, n where there is none."""
        x = np.asarray(x, U)
        high = (x >> U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
        low = x & self._mask()
        a, end = self._up_to(high - 1), self._up_to(high)
        b = end.copy()
        while len(live := np.flatnonzero(a < b)):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
        return a

    def contains(self, x: np.ndarray) -> np.ndarray:
        """Whether each x is a key: its successor is itself."""
        x = np.asarray(x, U)
        if not self.n:
            return np.zeros(len(x), bool)
        i = self.successor(x)
        high = (x >> U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
        return (i < self._up_to(high)) & (self._low(np.minimum(i, self.n - 1)) == (x & self._mask()))

    def keys(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """The keys from the i-th to before the j-th, sorted; only the words that hold them are opened."""
        j = self.n if j is None else min(j, self.n)
        if i >= j:
            return np.zeros(0, U)
        before = 64 * np.arange(len(self.upper)) - self.zeros  # ones in earlier words
        w, e = np.searchsorted(before, [i, j - 1], side="right") - 1
        ones = np.flatnonzero(_bits_of(self.upper[w : e + 1]).reshape(-1)) + 64 * int(w)
        ones = ones[i - before[w] : j - before[w]]
        at = np.arange(i, j)
        return ((ones - at).astype(U) << U(self.low_bits) if self.low_bits < 64 else np.zeros(j - i, U)) | self._low(at)

    def nbytes(self) -> int:
        return self.upper.nbytes + self.lower.nbytes + self.zeros.nbytes


def union(a: EliasFano, b: EliasFano, block: int = 1 << 16) -> EliasFano:
    """Two sets without a common key as one, merged in sequence: about `block` keys of either are plain at a time."""

    def blocks() -> Iterable[np.ndarray]:
        i = j = 0
        while i < a.n or j < b.n:
            x, y = a.keys(i, i + block), b.keys(j, j + block)
            # up to the lesser of the two blocks' ends nothing else can come between
            if len(x) and len(y):
                end = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, end, side="right")], y[: np.searchsorted(y, end, side="right")]
            i, j = i + len(x), j + len(y)
            yield np.sort(np.concatenate([x, y]), kind="stable")

    return EliasFano.of(blocks(), a.n + b.n, max(a.last, b.last), a.bits)


class SeenSet:
    """Keys met so far, in few Elias-Fano runs; a new run is merged with its elders while they are not twice its size."""

    def __init__(self, bits: int = 64):
        self.bits, self.runs = bits, []

    def contains(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for run in self.runs:
            out |= run.contains(x)
        return out

    def add(self, new: np.ndarray, block: int = 1 << 16) -> None:
        """Sorted distinct keys, none of them met before."""
        if not len(new):
            return
        run = EliasFano(new, self.bits)
        while self.runs and self.runs[-1].n < 2 * run.n:
            run = union(self.runs.pop(), run, block)
        self.runs.append(run)

    def __len__(self) -> int:
        return sum(run.n for run in self.runs)
