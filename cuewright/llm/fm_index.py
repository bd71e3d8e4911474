"""An FM-index over integer symbols, held in few flat numpy arrays, for many searches at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling over what is still tied.

    Symbol 0 is a separator, and the last symbol is one: each is smaller than any other symbol and
    unlike every other separator, so that no comparison goes past it.
    """
    gaps = symbols == 0
    start = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    order = np.argsort(start, kind="stable")
    rank = np.empty(len(symbols), np.int64)
    todo, key = np.arange(len(symbols)), start[order]
    step = 1
    while len(todo):
        # ``todo``: places in the order, group after group; a group's rank is the place of its first
        index = order[todo]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        rank[index] = np.repeat(todo[first], sizes)
        tied = np.repeat(sizes > 1, sizes)
        todo, index = todo[tied], index[tied]
        key = rank[index] << 32 | rank[index + step] if len(todo) else todo  # ties hold no separator yet
        by = np.argsort(key)
        key = key[by]
        order[todo] = index[by]
        step *= 2
    return order


class Bits:
    """A bit vector with counts of ones before each word."""

    def __init__(self, words: np.ndarray, before: np.ndarray) -> None:
        self.words, self.before = words, before

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        return cls(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Ranks of a symbol before a position, one bit of the symbol a level, the highest first."""

    def __init__(self, levels: list[Bits], zeros: np.ndarray, size: int) -> None:
        self.levels, self.zeros = levels, zeros
        everything = np.arange(size)
        self.origin = self._descend(everything, np.zeros(size, np.int64))

    @classmethod
    def of(cls, values: np.ndarray, size: int) -> WaveletMatrix:
        levels, zeros, now = [], [], values
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            levels.append(Bits.of(bit))
            zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(levels, np.array(zeros, np.int64), size)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (bits, zeros) in enumerate(zip(self.levels, self.zeros.tolist(), strict=True)):
            up = bits.rank(at)
            at = np.where((symbol >> (len(self.levels) - 1 - depth)) & 1 == 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self._descend(symbol, before) - self.origin[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how many of it are before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros.tolist(), strict=True):
            bit, up = bits.get(at), bits.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit == 1, zeros + up, at - up)
        return symbol, at - self.origin[symbol]


class FMIndex:
    """Counts and places of phrases in a text of symbols 1 .. size-1 with separators 0, the last symbol one."""

    def __init__(self, n: int, first: np.ndarray, tree: WaveletMatrix, kept: Bits, places: np.ndarray) -> None:
        self.n, self.first, self.tree, self.kept, self.places = n, first, tree, kept, places

    @classmethod
    def of(cls, symbols: np.ndarray, size: int, sample: int = 8) -> FMIndex:
        order = suffix_order(symbols)
        previous = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))[:-1]])
        kept = (order % sample == 0) | (previous == 0)  # a step back never crosses a separator
        return cls(len(symbols), first, WaveletMatrix.of(previous, size), Bits.of(kept), order[kept].astype(np.int32))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each phrase (rows of one length), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
            gone = live[low[live] >= high[live]]
            low[gone] = high[gone] = 0
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps back to the nearest sampled position."""
        place, at, left = np.full(len(rows), -1, np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(left):
            found = self.kept.get(at[left]) == 1
            done = left[found]
            place[done] = self.places[self.kept.rank(at[done])] + steps
            left = left[~found]
            c, before = self.tree.symbol_and_rank(at[left])
            at[left] = self.first[c] + before
            steps += 1
        return place

    def arrays(self) -> list[np.ndarray]:
        bits = [self.kept, *self.tree.levels]
        return [np.array([self.n, len(self.first)], np.int64), self.first, self.tree.zeros, self.places, *(x for b in bits for x in (b.words, b.before))]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> FMIndex:
        (n, size), first, zeros, places, *rest = arrays
        kept, *levels = (Bits(rest[k], rest[k + 1]) for k in range(0, len(rest), 2))
        return cls(int(n), first, WaveletMatrix(levels, zeros, int(size)), kept, places)


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays in a row, each with its kind and length before it and padded to eight bytes."""
    parts = []
    for x in arrays:
        parts += [x.dtype.str.encode().ljust(8), np.int64(x.nbytes).tobytes(), x.tobytes(), b"\0" * (-x.nbytes % 8)]
    return b"".join(parts)


def from_bytes(data: bytes | memoryview) -> list[np.ndarray]:
    """The arrays, as views of the data."""
    out, at = [], 0
    while at < len(data):
        kind, n = np.dtype(bytes(data[at : at + 8]).decode().strip()), int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(data, kind, n // kind.itemsize, at + 16))
        at += 16 + n + -n % 8
    return out
