"""Words and lines of a whole Arrow string column as numpy arrays over its UTF-8 bytes.

Separators of every operator here are ASCII bytes, so cutting UTF-8 at bytes equals cutting at
characters.  Keys are 64-bit polynomial hashes with a finaliser, from prefix sums: no Python
object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes (a longer text is one slice).
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as was needed so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


class Hasher:
    """Hashes of byte ranges, after lower-casing A-Z unless told otherwise."""

    def __init__(self, seed: int, lower: bool = True) -> None:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.values = values[LOWER] if lower else values
        self.powers = _Powers(int(mix(np.array([seed + 77], np.uint64))[0]) | 5)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers.get(len(data))
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Process-wide, as their tables of powers are worth keeping between batches.
FIRST, SECOND, EXACT = Hasher(11), Hasher(5_000_011), Hasher(17, lower=False)


def key_of(text: str, hasher: Hasher = FIRST) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hasher.ranges(data, np.array([0]), np.array([len(data)]))[0])


class Piece(NamedTuple):
    """Rows ``first .. last`` of a column: their bytes, and where each text begins and ends in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def pieces(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Piece]:
    """The column (nulls: empty texts) in slices of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + slice_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        lo = bounds[first]
        yield Piece(first, last, data[lo : bounds[last]], bounds[first : last + 1] - lo)
        first = last


def words(piece: Piece, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and the words' number in each text."""
    n = len(piece.data)
    counts = len(piece.bounds) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(counts, np.int64)
    inside = in_word[piece.data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = piece.bounds[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, piece.bounds))


class Lines(NamedTuple):
    """Lines of a piece: bytes of the raw line, of the stripped line, text number, code points."""

    starts: np.ndarray
    ends: np.ndarray
    key_starts: np.ndarray
    key_ends: np.ndarray
    row: np.ndarray
    chars: np.ndarray


def lines(piece: Piece) -> Lines:
    """Every text cut at ``\\n`` (an empty text is one empty line); keys are stripped of white space."""
    data, bounds = piece.data, piece.bounds
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([bounds[1:], cut]), kind="stable")
    per_row = np.diff(np.searchsorted(cut, bounds)) + 1
    row = np.repeat(np.arange(len(bounds) - 1), per_row)
    solid = np.flatnonzero(NOT_SPACE[data])
    solid = np.append(solid, len(data))
    key_starts = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    at = np.searchsorted(solid, ends) - 1
    key_ends = np.where(at >= 0, solid[at] + 1, starts)
    key_ends = np.maximum(np.minimum(key_ends, ends), key_starts)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return Lines(starts, ends, key_starts, key_ends, row, heads[key_ends] - heads[key_starts])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i]+sizes[i]-1 of all i in a row."""
    sizes = sizes.astype(np.int64)
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)


def row_slices(batches: Iterator[pa.RecordBatch], column: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``slice_bytes`` of text, to bound a task's memory."""
    for batch in batches:
        for piece in pieces(batch.column(column), slice_bytes):
            yield batch.slice(piece.first, piece.last - piece.first)
