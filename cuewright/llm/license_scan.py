"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are license notices; shingles are ``shingle`` consecutive words (of a notice of fewer: as
many as it has, of the text too).  Templates of between L/2 and L shingles form a class (L = 1, 2, 4,
...), which is looked for in windows of about 2.5 * L shingles that begin every L/2.  A notice that a
text contains to the share ``containment`` within 2 * L + 1 shingles then lies in some window with a
Jaccard similarity of at least J, known for each class; with one MinHash value a band and ``bands`` =
log(miss) / log(1 - J) bands it shares one with probability over 1 - miss.  Retrieved pairs are
verified on the words themselves, of the window and as many on both sides as a notice can reach.

A document's result depends on itself and the templates (a given list, sent to the tasks), so there
is no shuffle and no hot key.

Defined results: null and wordless texts have no match; a text that repeats a notice gets a match
for each separate occurrence; templates without words never match; rows that repeat an id
are each scanned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notices import NOTICES
from .text_arrays import ALNUM, FIRST, Piece, mix, pieces, spread, words

MISS = 1e-4


class SizeClass:
    """Templates of about one size, with the windows and bands that find them."""

    def __init__(self, shingle: int, size: int, templates: list[tuple[int, np.ndarray]], containment: float, miss: float) -> None:
        self.shingle, self.reach = shingle, 2 * size + shingle  # words that an occurrence may span
        self.step = max(1, size // 2)
        self.blocks = 1 if size == 1 else 5
        window = self.step * self.blocks
        fewest = size // 2 + 1 if size > 1 else 1
        shared = math.ceil(containment * fewest)
        jaccard = min(1.0, shared / (window + fewest - shared))
        self.bands = 1 if jaccard == 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))
        self.factors = mix(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) | np.uint64(1)
        self.names = np.array([k for k, _ in templates])
        self.least = np.array([[(h * f).min() for f in self.factors] for _, h in templates], np.uint64)

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first shingle within the row, template) of windows that share a band."""
        per_row = -(-counts // self.step)
        row = np.repeat(np.arange(len(counts)), per_row)
        if not len(row):
            return row, row, row
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        within = spread(np.zeros(len(counts), np.int64), per_row) * self.step
        at = begins[row] + within
        last = np.ones(len(row), bool)
        last[:-1] = row[1:] != row[:-1]
        found = []
        for band, factor in enumerate(self.factors):
            least = np.minimum.reduceat(shingles * factor, at)
            block = least
            for _ in range(self.blocks - 1):  # the block itself and one more of those after it
                longer = block.copy()
                longer[:-1] = np.where(last[:-1], block[:-1], np.minimum(block[:-1], least[1:]))
                least = longer
            for k, value in enumerate(self.least[:, band]):
                hit = np.flatnonzero(least == value)
                found.append(hit * len(self.names) + k)
        pairs = np.unique(np.concatenate(found))
        window, which = pairs // len(self.names), self.names[pairs % len(self.names)]
        return row[window], within[window], which


class Templates:
    def __init__(self, notices: dict[str, str], shingle: int, containment: float, miss: float = MISS) -> None:
        self.names, self.containment = list(notices), containment
        self.words: list[list[bytes]] = []
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for k, text in enumerate(notices.values()):
            piece = next(pieces(pa.array([text], pa.string())))
            starts, ends, _ = words(piece, ALNUM)
            raw = piece.data.tobytes().lower()
            self.words.append([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            own = min(shingle, len(starts))
            hashes, _ = shingles(FIRST.ranges(piece.data, starts, ends), np.array([len(starts)]), own)
            if len(hashes):
                classes.setdefault((own, 1 << math.ceil(math.log2(len(hashes)))), []).append((k, np.unique(hashes)))
        self.classes = [SizeClass(n, size, own, containment, miss) for (n, size), own in sorted(classes.items())]
        self.sets = [self.shingle_set(w, shingle) for w in self.words]

    @staticmethod
    def shingle_set(w: list[bytes], shingle: int) -> set[tuple[bytes, ...]]:
        n = min(shingle, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def shingles(word_hashes: np.ndarray, counts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each has (short texts: one of all words)."""
    n = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    begin = spread(first, n)
    most = np.repeat(np.minimum(counts, shingle), n)
    out = np.zeros(len(begin), np.uint64)
    for k in range(shingle):
        inside = most > k
        out[inside] = out[inside] * np.uint64(0x9E3779B97F4A7C15) + word_hashes[begin[inside] + k]
    return mix(out), n


def occurrences(text: list[bytes], want: set[tuple[bytes, ...]], k: int, reach: int, containment: float) -> list[tuple[float, int, int]]:
    """(share, first word, word after the last) of the separate places that hold enough of ``want``."""
    places = [(p, gram) for p in range(len(text) - k + 1) if (gram := tuple(text[p : p + k])) in want]
    out, i = [], 0
    while i < len(places):
        seen, last = {}, i
        for j in range(i, len(places)):
            p, gram = places[j]
            if p + k - places[i][0] > reach or gram in seen and len(seen) >= containment * len(want):
                break
            if gram not in seen:
                last = j
            seen[gram] = seen.get(gram, 0) + 1
        if len(seen) < containment * len(want):
            i += 1
            continue
        begin = i
        while sum(g == places[begin][1] for _, g in places[begin : last + 1]) > 1:  # repeated nearer to the rest
            begin += 1
        out.append((len(seen) / len(want), places[begin][0], places[last][0] + k))
        i = last + 1
    return out


def scan_piece(piece: Piece, templates: Templates) -> list[list[dict]]:
    """The matches of every text of a slice."""
    starts, ends, counts = words(piece, ALNUM)
    word_hashes = FIRST.ranges(piece.data, starts, ends)
    by_length = {k: shingles(word_hashes, counts, k) for k in {own.shingle for own in templates.classes}}
    first = np.concatenate([[0], np.cumsum(counts)])
    found: list[tuple[int, int, int, int, float]] = []
    raw = None
    for own in templates.classes:
        rows, within, which = own.candidates(*by_length[own.shingle])
        width = own.step * own.blocks + own.shingle - 1
        order = np.lexsort((within, which, rows))
        regions: list[list[int]] = []  # overlapping windows of a template are verified together
        for row, at, template in zip(rows[order].tolist(), within[order].tolist(), which[order].tolist(), strict=True):
            a, b = max(0, at - own.reach), min(int(counts[row]), at + width + own.reach)
            if regions and regions[-1][:2] == [row, template] and a <= regions[-1][3]:
                regions[-1][3] = b
            else:
                regions.append([row, template, a, b])
        for row, template, a, b in regions:
            raw = raw if raw is not None else piece.data.tobytes()
            lo, hi = first[row] + a, first[row] + b
            text = [raw[x:y].lower() for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            found.extend((row, template, a + x, a + y, share) for share, x, y in occurrences(text, templates.sets[template], own.shingle, own.reach, templates.containment))
    out: list[list[dict]] = [[] for _ in range(len(counts))]
    for row, template, a, b, share in sorted(found):
        out[row].append({"license": templates.names[template], "containment": share, "begin": a, "end": b})
    return out


MATCH = "array<struct<license:string,containment:double,begin:long,end:long>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """id and matches (license, containment, first word and the word after the last) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(NOTICES if notices is None else notices, shingle, containment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for piece in pieces(batch.column(1)) for m in scan_piece(piece, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["id", "matches"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, matches {MATCH}").withColumnRenamed("id", id_col)
