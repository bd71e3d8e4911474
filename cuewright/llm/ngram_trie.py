"""A two-level n-gram trie in Elias-Fano form, over byte arrays that can be memory-mapped.

Level 1 holds the contexts and pointers into level 2; level 2 holds each context's successors, made
one increasing sequence by adding the last value before the context's range, beside a 16-bit code of
each entry's log10 probability.  A query is a successor search for word + 1 + that value.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: log10 probabilities from -LOWEST to 0 in 65535 steps, rounded down.
LOWEST = 16.0
#: The place of the k-th set bit of a byte, lowest first.
_SELECT = np.array([[([b for b in range(8) if byte >> b & 1] + [0] * 8)[k] for k in range(8)] for byte in range(256)], np.int64)
_U = np.uint64
_BYTES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
_ODD, _PAIRS, _NIBBLES = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def _select_in_words(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word: sums of its bytes side by side, then a table for one byte."""
    sums = word - (word >> _U(1) & _ODD)
    sums = (sums & _PAIRS) + (sums >> _U(2) & _PAIRS)
    sums = (sums + (sums >> _U(4)) & _NIBBLES) * _BYTES  # each byte: the ones up to its end
    k = k.astype(np.uint64)
    place = (((k * _BYTES | _HIGHS) - sums & _HIGHS) >> _U(7)) * _BYTES >> _U(56) << _U(3)  # bytes that end before the k-th one
    before = (sums << _U(8)) >> place & _U(255)
    return place.astype(np.int64) + _SELECT[(word >> place & _U(255)).astype(np.int64), (k - before).astype(np.int64)]


def coded(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((log10 + LOWEST) / LOWEST * 65535), 0, 65535).astype(np.uint16)


def uncoded(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / 65535 * LOWEST - LOWEST


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts as a unary bit vector with counts."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before
        self.words = high.view(np.uint64)
        self.zeros = np.arange(len(before)) * 64 - before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            part, at = (values & ((1 << bits) - 1)).astype(np.uint64), np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        flags = np.zeros(((n + (top >> bits) + 2 + 63) // 64) * 64, np.uint8)
        flags[(values >> bits) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high.view(np.uint64)))]).astype(np.int64)
        return cls(n, bits, low, high, before)

    def _ones(self, k: np.ndarray) -> np.ndarray:
        """Bit positions of the k-th ones."""
        word = np.searchsorted(self.before, k, "right") - 1
        return word * 64 + _select_in_words(self.words[word], k - self.before[word])

    def _nulls(self, k: np.ndarray) -> np.ndarray:
        """Bit positions of the k-th zeros."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select_in_words(~self.words[word], k - self.zeros[word])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (part & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._ones(i) - i) << self.low_bits | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x in a strictly increasing sequence; -1 if it isn't there."""
        upper = x >> self.low_bits
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero((x >= 0) & (upper < self.zeros[-1]) & (self.n > 0))
        upper, low = upper[ok], x[ok] & ((1 << self.low_bits) - 1)
        end = self._nulls(upper) - upper
        begin = np.where(upper > 0, self._nulls(np.maximum(upper - 1, 0)) - (upper - 1), 0)
        a, b = begin, end.copy()
        while True:  # binary search among the elements of one upper part
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            middle = (a[live] + b[live]) >> 1
            less = self._lows(middle) < low[live]
            a[live[less]] = middle[less] + 1
            b[live[~less]] = middle[~less]
        hit = np.flatnonzero(a < end)
        hit = hit[self._lows(a[hit]) == low[hit]]
        out[ok[hit]] = a[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.before]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, before)


_KINDS = [np.int64, np.uint64, np.uint8, np.int64] * 3 + [np.uint16]


class NgramTrie:
    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> NgramTrie:
        """Entries sorted by (context, word)."""
        firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        lasts = np.append(firsts[1:], len(context)) - 1 if len(firsts) else firsts
        reach = np.concatenate([[0], np.cumsum(word[lasts] + 1)])
        sizes = lasts - firsts + 1
        return cls(EliasFano.of(context[firsts]), EliasFano.of(np.append(firsts, len(context))), EliasFano.of(word + 1 + np.repeat(reach[:-1], sizes)), coded(log10))

    def query(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the entries (-1: none), of rows sorted by context."""
        out = np.full(len(context), -1, np.int64)
        if not len(context):
            return out
        firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        at = self.contexts.find(context[firsts])
        known = np.flatnonzero(at >= 0)
        begin, end = self.pointers.access(at[known]), self.pointers.access(at[known] + 1)
        base = np.zeros(len(known), np.int64)
        later = begin > 0
        base[later] = self.successors.access(begin[later] - 1)
        sizes = np.diff(np.append(firsts, len(context)))
        asked = np.flatnonzero(np.repeat(at >= 0, sizes))
        begin, end, base = (np.repeat(x, sizes[known]) for x in (begin, end, base))
        found = self.successors.find(base + word[asked] + 1)
        inside = (found >= begin) & (found < end)
        out[asked[inside]] = found[inside]
        return out

    def to_bytes(self) -> bytes:
        parts = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.codes]
        sizes = np.array([p.nbytes for p in parts], np.int64)
        pad = lambda p: p.tobytes() + b"\0" * (-p.nbytes % 8)
        return sizes.tobytes() + b"".join(pad(p) for p in parts)

    @classmethod
    def from_buffer(cls, data) -> NgramTrie:
        n = len(_KINDS)
        sizes = np.frombuffer(data, np.int64, n)
        at, parts = 8 * n, []
        for size, kind in zip(sizes.tolist(), _KINDS, strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        return cls(*(EliasFano.from_arrays(*parts[k : k + 4]) for k in (0, 4, 8)), *parts[12:])

    @classmethod
    def mapped(cls, data: bytes) -> NgramTrie:
        """The levels in an unnamed, memory-mapped file, which goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
