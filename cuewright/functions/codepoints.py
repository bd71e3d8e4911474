"""Whole texts as arrays of code points: normalising and counting a column of long texts in a few numpy passes.

Equal to the regular expressions of ``text`` and ``recognition``, which suit lines; a batch of documents is cut,
classified and counted at once here.  A slice of about ``SLICE`` bytes is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Bytes of text that are held as code points at once (a longer text is one slice).
SLICE = 1 << 20
SPACE, LETTER, DIGIT, MARK, CORE, SMALL, BIG = (1 << k for k in range(7))
#: White space beyond ASCII, and marks that are no noise beside the ASCII ones.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_MARKS = "“”‘’…"
#: Octets from which a word is long, and letters from which a run of them is too long for a label.
LONG_WORD, LONG_RUN = 14, 14


@cache
def classes() -> np.ndarray:
    """The classes of each code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for m in regex.finditer(r"\p{Alphabetic}+", every):
        out[m.start() : m.end()] |= LETTER
    out[[ord(c) for c in " \t\n\x0b\x0c\r" + WIDE_SPACES]] |= SPACE
    out[0x30:0x3A] |= DIGIT
    for a, b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
        out[a:b] |= MARK
    out[[ord(c) for c in WIDE_MARKS]] |= MARK
    out[0x41:0x5B] |= CORE | BIG
    out[0x61:0x7B] |= CORE | SMALL
    out[0x27] |= CORE
    return out


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, bounds of the texts) of a string column, some texts at a time; nulls are empty texts."""
    column = pc.fill_null(column, "") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = min(max(int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1, first + 1), n)
        raw = data[bounds[first] : bounds[last]]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        yield points, heads[bounds[first : last + 1] - bounds[first]]
        first = last


def strings(points: np.ndarray, bounds: np.ndarray) -> list[str]:
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _kept(points: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def normalised(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines trimmed, empty ones and carriage returns gone, joined by line feeds."""
    returns = points == 0x0D
    if returns.any():
        points, bounds = _kept(points, bounds, ~returns)
    feeds = np.flatnonzero(points == 0x0A)
    starts, ends = np.sort(np.concatenate([bounds[:-1], feeds + 1])), np.sort(np.concatenate([feeds, bounds[1:]]))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(feeds, bounds)) + 1)
    solid = np.flatnonzero(classes()[points] & SPACE == 0)
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(b > a)
    edge = np.zeros(len(points) + 1, np.int8)
    edge[solid[a[full]]] = 1
    edge[solid[b[full] - 1] + 1] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep[ends[full[:-1][text[full[:-1]] == text[full[1:]]]]] = True  # the line feed before a further line of the text
    return _kept(points, bounds, keep)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def counts(points: np.ndarray, bounds: np.ndarray, short_words: frozenset[str]) -> dict[str, np.ndarray]:
    """What the quality score needs of normalised texts, a number a text each."""
    kind = classes()[points]
    n = len(points)
    is_ = lambda c: kind & c != 0
    out = {"chars": np.diff(bounds)} | {name: _per_text(is_(c), bounds) for name, c in (("letters", LETTER), ("digits", DIGIT), ("spaces", SPACE), ("marks", MARK))}
    pair = np.zeros(n, bool)
    pair[:-1] = (points[:-1] == 0x40) & (points[1:] == 0x26)
    pair[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)] - 1] = False  # not over two texts
    out |= {"glitch": _per_text(pair, bounds) > 0, "bar": _per_text(points == 0x7C, bounds) > 0}
    # words: runs without white space
    solid = ~is_(SPACE)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])[:n]))
    stops = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]])[:n])) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    per = lambda flags: np.bincount(text[flags], minlength=len(bounds) - 1)
    octets = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
    out |= {"words": np.maximum(per(np.ones(len(starts), bool)), 1), "long": per(octets[stops] - octets[starts] >= LONG_WORD)}
    # bare words: from the first to the last letter or apostrophe, if all between is ASCII
    at, core = np.arange(n), is_(CORE)
    first = np.append(np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1], n)[starts] if n else starts
    last = np.maximum.accumulate(np.where(core, at, -1))[stops - 1] + 1 if n else stops
    wide = np.concatenate([[0], np.cumsum(points >= 0x80)])
    bare = (first < stops) & (last > starts)
    bare &= wide[np.where(bare, last, 0)] == wide[np.where(bare, first, 0)]
    size = last - first
    brief = bare & (size <= 2)
    common = {tuple(map(ord, w.ljust(2))) for w in short_words}
    letters = np.where(is_(BIG), points + 32, points)
    a, b = letters[first[brief]], np.where(size[brief] == 2, letters[np.minimum(first[brief] + 1, max(n - 1, 0))], 0x20)
    known = np.isin(a.astype(np.int64) << 32 | b, np.array([x << 32 | y for x, y in common], np.int64))
    short = np.zeros(len(starts), bool)
    short[np.flatnonzero(brief)] = ~known
    hump = np.zeros(n + 1, np.int64)
    hump[1:n] = np.cumsum(is_(SMALL)[:-1] & is_(BIG)[1:]) if n > 1 else 0  # hump[k]: pairs that end at k or before
    hump[n] = hump[n - 1] if n else 0
    camel = np.zeros(len(starts), bool)
    which = np.flatnonzero(bare)
    camel[which] = hump[last[which] - 1] > hump[first[which]]
    return out | {"ascii": per(bare), "short": per(short), "camel": per(camel)}


def long_runs(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a text has a run of ``LONG_RUN`` letters, apostrophes between them aside."""
    kind = classes()[points]
    letter = kind & LETTER != 0
    run = letter | (points == 0x27)
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(run & (edge[:-1] | ~np.concatenate([[False], run[:-1]])[:n]))
    stops = np.flatnonzero(run & (edge[1:] | ~np.concatenate([run[1:], [False]])[:n])) + 1
    total = np.concatenate([[0], np.cumsum(letter)])
    return np.bincount((np.searchsorted(bounds, starts, "right") - 1)[total[stops] - total[starts] >= LONG_RUN], minlength=len(bounds) - 1) > 0


def _of_texts(texts: pa.Array, made: Callable[[np.ndarray, np.ndarray], list[str]]) -> pa.Array:
    """A text for each; those of a slice become Arrow data before the next is cut, so that one slice of strings is held."""
    valid, first, out = texts.is_valid().to_numpy(zero_copy_only=False), 0, []
    for points, bounds in slices(texts):
        own = made(points, bounds)
        out.append(pa.array(own, pa.string(), mask=~valid[first : first + len(own)]))
        first += len(own)
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def normalised_texts(texts: pa.Array) -> pa.Array:
    """``text.normalise_lines`` of long texts."""
    return _of_texts(texts, lambda p, b: strings(*normalised(p, b)))


#: Typographic quotes and what evaluation reads them as.
QUOTES = {0x201C: 0x22, 0x201D: 0x22, 0x2018: 0x27, 0x2019: 0x27}


def collapsed(points: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Quotes made plain, each run of white space one space, none at the ends, an ellipsis as three dots."""
    points = points.copy()
    for was, now in QUOTES.items():
        points[points == was] = now
    space = classes()[points] & SPACE != 0
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    at = np.flatnonzero(space)
    apart = np.ones(len(at) + 1, bool)  # whether a run begins at at[k], and ends before it
    apart[1:-1] = (np.diff(at) > 1) | edge[at[1:]]
    first, last = at[apart[:-1]], at[apart[1:]]
    keep = ~space
    keep[first[~edge[first] & ~edge[last + 1]]] = True
    points[space] = 0x20
    return [s.replace("…", "...") for s in strings(*_kept(points, bounds, keep))]


@F.arrow_udf(StringType())
def collapsed_texts(texts: pa.Array) -> pa.Array:
    """``text.evaluation_text`` of long texts."""
    return _of_texts(texts, collapsed)


COUNTED = StructType([StructField(c, LongType()) for c in ("chars", "letters", "digits", "spaces", "marks", "words", "long", "ascii", "short", "camel")] + [StructField(c, BooleanType()) for c in ("glitch", "bar", "run")])


def counted_texts(text: Column, short_words: list[str]) -> Column:
    """The counts of each normalised text as a struct, and whether the text itself has a long run of letters."""
    common = frozenset(short_words)

    @F.arrow_udf(COUNTED)
    def made(texts: pa.Array) -> pa.Array:
        parts: dict[str, list[np.ndarray]] = {f.name: [np.zeros(0, np.int64)] for f in COUNTED}
        for points, bounds in slices(texts):
            for name, values in (counts(*normalised(points, bounds), common) | {"run": long_runs(points, bounds)}).items():
                parts[name].append(values)
        fields = [pa.field(f.name, pa.bool_() if isinstance(f.dataType, BooleanType) else pa.int64()) for f in COUNTED]
        whole = {f.name: np.concatenate(parts[f.name]).astype(bool if f.type == pa.bool_() else np.int64) for f in fields}
        columns = [pa.array(whole[f.name], f.type, mask=whole["ascii"] == 0 if f.name == "ascii" else None) for f in fields]  # a share of none is null
        return pa.StructArray.from_arrays(columns, fields=fields, mask=pc.is_null(texts))

    return made(text)
