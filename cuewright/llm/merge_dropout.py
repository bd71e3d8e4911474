"""SentencePiece BPE encoding with seeded merge-dropout, and decoding that gives the text back.

The model file is a public tokenizer's; nothing is trained.  A text gets the leading space mark that
the model's normaliser adds, and is cut before each run of spaces, which no piece of the vocabulary
crosses.  Candidate merges of such a part go through an agenda, best score first and leftmost among
equals.  A candidate is skipped for good if the keyed hash of (seed, document, place in it, part,
where the two symbols begin and end) falls under ``dropout``.  So runs agree wherever and however
often a task runs, while each occurrence of a word is cut by decisions of its own.

Without dropout equal parts of a slice are encoded once, else each occurrence by itself.  Parts of up
to ``SHORT`` symbols go through the agenda side by side in numpy, one merge of each part a round, as
many parts at once as make about ``ROUND`` symbols; longer ones through a heap.

Lossless: characters without a piece become byte pieces, and so do the space mark itself where a
text holds it and bytes that are no UTF-8.  Defined results: null and empty texts have no pieces and decode to the empty text;
rows that repeat an id and text get the same pieces; a null id counts as an empty one in the key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import thrifty
from .text_arrays import EXACT, Piece, mix, pieces, row_slices, spread

MARK = "▁"
SHORT, ROUND = 48, 1 << 18
NONE = np.int64(1 << 40)
#: Text that a task encodes together: its arrays are some 400 times as large in all.
ENCODED_BYTES = 1 << 18


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback, as arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(model.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        plain = {t: i for i, t in enumerate(texts) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(MARK in t.lstrip(MARK) for t in plain):
            raise ValueError("a piece crosses a space")
        self.size = size
        self.dummy_prefix = texts[model.encode("a")[0]].startswith(MARK)
        # symbols: pieces, then characters that only occur inside pieces, then size + 2**16 + code point
        extra = sorted({c for t in plain for c in t} - set(plain))
        self.symbols = dict(plain) | {c: size + k for k, c in enumerate(extra)}
        order = sorted(plain.values(), key=lambda i: -model.get_score(i))
        self.rank = np.zeros(size, np.int64)
        self.rank[order] = np.arange(len(order))
        pairs = {(self.symbols[t[:k]], self.symbols[t[k:]]): i for t, i in plain.items() for k in range(1, len(t)) if t[:k] in self.symbols and t[k:] in self.symbols}
        self._hash_pairs(pairs)
        self.chars = np.full(1 << 16, -1, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1 and ord(c) < 1 << 16:
                self.chars[ord(c)] = i
        self.chars[ord(MARK)] = -1
        self.chars[32] = self.symbols[MARK]
        self.far = {ord(c): i for c, i in self.symbols.items() if len(c) == 1 and ord(c) >= 1 << 16}
        known = set(plain.values())
        outs = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else (t.replace(MARK, " ").encode() if i in known else b"") for i, t in enumerate(texts)]
        self.out_bytes = np.frombuffer(b"".join(outs), np.uint8)
        self.out_sizes = np.array([len(x) for x in outs])
        self.out_at = np.concatenate([[0], np.cumsum(self.out_sizes)[:-1]])

    def _hash_pairs(self, pairs: dict[tuple[int, int], int]) -> None:
        """An open-addressing table of (left, right) -> merged piece."""
        self.slots = 1 << int(np.ceil(np.log2(len(pairs) * 4 + 4)))
        self.keys, self.merged = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int64)
        self.pairs = pairs
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        for key, at, to in zip((left << 32 | right).tolist(), self._slot(left << 32 | right).tolist(), pairs.values(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) % self.slots
            self.keys[at], self.merged[at] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make; -1 if none."""
        key = left << 32 | right
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            at[todo] = (at[todo] + 1) & (self.slots - 1)
        return out

    def symbols_of(self, points: np.ndarray) -> np.ndarray:
        out = self.chars[np.minimum(points, (1 << 16) - 1)]
        for k in np.flatnonzero(points >= 1 << 16).tolist():
            out[k] = self.far.get(int(points[k]), -1)
        return np.where((out < 0) | (points == (1 << 16) - 1), self.size + (1 << 16) + points, out)


def _skipped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed decision about a candidate merge."""
    u = np.uint64
    place = begin.astype(u) * u(0x9E3779B97F4A7C15) + middle.astype(u) * u(0xC2B2AE3D27D4EB4F) + end.astype(u) * u(0x165667B19E3779F9)
    return (mix(key ^ mix(place)) >> u(11)).astype(np.float64) * 2.0**-53 < dropout


def merge_short(model: PieceModel, symbols: np.ndarray, part: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their part (0, 1, ...), by one agenda step of every part a round."""
    counts = np.bincount(part, minlength=len(key))
    begin = spread(np.zeros(len(key), np.int64), counts)
    end = begin + 1

    def propose(at: np.ndarray) -> None:
        """The pairs (at, at + 1): their rank if they may merge, else NONE, and what they make."""
        made = model.merge_of(symbols[at], symbols[at + 1])
        ok = np.flatnonzero(made >= 0)
        if dropout > 0 and len(ok):
            a = at[ok]
            ok = ok[~_skipped(key[part[a]], begin[a], end[a], end[a + 1], dropout)]
        rank[at] = NONE
        rank[at[ok]] = model.rank[made[ok]]
        to[at[ok]] = made[ok]

    rank, to = np.full(len(symbols), NONE, np.int64), np.zeros(len(symbols), np.int64)
    propose(np.flatnonzero(part[1:] == part[:-1]) if len(part) else np.zeros(0, np.int64))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(firsts, len(symbols)))
        offset = np.arange(len(symbols)) - np.repeat(firsts, sizes)  # under 64, as parts are short
        best = np.minimum.reduceat(rank * 64 + offset, firsts)
        going = best < NONE * 64
        stays = np.repeat(~going, sizes)
        done.append((part[stays], symbols[stays]))
        if not going.any():
            break
        at = firsts[going] + best[going] % 64
        symbols[at] = to[at]
        end[at] = end[at + 1]
        keep = ~stays
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        new = moved[at]
        symbols, part, begin, end, rank, to = symbols[keep], part[keep], begin[keep], end[keep], rank[keep], to[keep]
        rank[new] = NONE
        beside = np.concatenate([new[new > 0] - 1, new[new + 1 < len(symbols)]])
        propose(beside[part[beside] == part[beside + 1]])
    parts = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
    out = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(parts, kind="stable")
    return out[order], parts[order]


def merge_long(model: PieceModel, symbols: list[int], key: int, dropout: float) -> list[int]:
    """The agenda over one part, as a heap; the same result as ``merge_short``."""
    n = len(symbols)
    begin, end = list(range(n)), list(range(1, n + 1))
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    alive = [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []
    own = np.array([key], np.uint64)

    def propose(ats: list[int]) -> None:
        found = [(a, after[a], model.pairs.get((symbols[a], symbols[after[a]]))) for a in ats if a >= 0 and after[a] >= 0]
        found = [x for x in found if x[2] is not None]
        if not found:
            return
        if dropout > 0:
            skip = _skipped(own, *(np.array(x) for x in zip(*((begin[a], end[a], end[b]) for a, b, _ in found), strict=True)), dropout).tolist()
        else:
            skip = [False] * len(found)
        for (a, b, to), no in zip(found, skip, strict=True):
            if not no:
                heapq.heappush(agenda, (int(model.rank[to]), a, symbols[a], symbols[b], to))

    propose(list(range(n - 1)))
    while agenda:
        _, a, left, right, to = heapq.heappop(agenda)
        b = after[a] if alive[a] else -1
        if b < 0 or symbols[a] != left or symbols[b] != right:
            continue
        symbols[a], end[a], alive[b] = to, end[b], False
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        propose([before[a], a])
    return [s for s, ok in zip(symbols, alive, strict=True) if ok]


def _encode_piece(model: PieceModel, piece: Piece, row_keys: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice in a row, and how many each text has."""
    data, bounds = piece.data, piece.bounds
    rows = len(bounds) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    blank = data == 32
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[heads] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))
    per_row = np.diff(np.searchsorted(starts, bounds))
    row = np.repeat(np.arange(rows), per_row)
    first = np.zeros(len(starts), bool)
    first[np.searchsorted(starts, heads)] = True
    first &= model.dummy_prefix
    u = np.uint64
    plain = EXACT.ranges(data, starts, ends) + first.astype(u)
    if dropout > 0:
        place = (np.arange(len(starts)) - np.repeat(np.concatenate([[0], np.cumsum(per_row)[:-1]]), per_row)).astype(u)
        keys = mix(plain + mix(row_keys[row] ^ mix(place + u(seed) * u(0x9E3779B97F4A7C15))) * u(0xD6E8FEB86659FD93) + u(seed))
        chosen = which = np.arange(len(keys))
    else:
        keys, chosen, which = np.unique(plain, return_index=True, return_inverse=True)
    # the chosen parts, with a space in front of those that open a text
    a, b, mark = starts[chosen], ends[chosen], first[chosen].astype(np.int64)
    sizes = b - a + mark
    source = spread(a - mark, sizes)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = data[np.maximum(source, 0)]
    raw[at[mark == 1]] = 32
    heads_ = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    n_chars = np.diff(heads_[np.append(at, len(raw))])
    try:
        text = raw.tobytes().decode()
    except UnicodeDecodeError:  # a byte that is no UTF-8 is a character of its own
        cut = [raw[x:y].tobytes().decode("utf-8", "surrogateescape") for x, y in zip(at.tolist(), np.append(at[1:], len(raw)).tolist(), strict=True)]
        text, n_chars = "".join(cut), np.array([len(x) for x in cut], np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbols = model.symbols_of(points)
    owner = np.repeat(np.arange(len(keys)), n_chars)
    short = n_chars <= SHORT
    in_short = short[owner]
    number = np.cumsum(short) - 1
    few, own, own_keys = symbols[in_short], number[owner[in_short]], keys[short]
    ends_ = np.cumsum(n_chars[short])
    done, lo = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while lo < len(own_keys):
        from_ = ends_[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends_, from_ + ROUND, "right")))
        merged, its = merge_short(model, few[from_ : ends_[hi - 1]], own[from_ : ends_[hi - 1]] - lo, own_keys[lo:hi], dropout)
        done.append((merged, its + lo))
        lo = hi
    out, parts = (np.concatenate(x) for x in zip(*done, strict=True))
    parts = np.flatnonzero(short)[parts]
    if not short.all():
        begins = np.concatenate([[0], np.cumsum(n_chars)])
        more = [(k, merge_long(model, symbols[begins[k] : begins[k + 1]].tolist(), int(keys[k]), dropout)) for k in np.flatnonzero(~short).tolist()]
        parts = np.concatenate([parts, *(np.full(len(x), k) for k, x in more)])
        out = np.concatenate([out, *(np.array(x, np.int64) for _, x in more)])
        order = np.argsort(parts, kind="stable")
        out, parts = out[order], parts[order]
    # characters without a piece
    odd = np.flatnonzero(out >= model.size)
    if len(odd):
        inside = {v: c for c, v in model.symbols.items() if v >= model.size}
        repeat, new = np.ones(len(out), np.int64), {}
        for k in odd.tolist():
            v = int(out[k])
            new[k] = model.byte_ids[list((inside.get(v) or chr(v - model.size - (1 << 16))).encode("utf-8", "surrogateescape"))]
            repeat[k] = len(new[k])
        at_new = np.concatenate([[0], np.cumsum(repeat)[:-1]])
        out, parts = np.repeat(out, repeat), np.repeat(parts, repeat)
        for k, ids in new.items():
            out[at_new[k] : at_new[k] + len(ids)] = ids
    counts = np.bincount(parts, minlength=len(keys))
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ids = out[spread(begins[which], counts[which])].astype(np.int32)
    return ids, np.bincount(row, counts[which], minlength=rows).astype(np.int64)


def encode_column(model: PieceModel, texts: pa.Array, row_keys: np.ndarray, *, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the bounds of each text's ids."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for piece in pieces(texts):
        own, n = _encode_piece(model, piece, row_keys[piece.first : piece.last], seed, dropout)
        ids.append(own)
        counts.append(n)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def decode_column(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and their bounds: ids backwards, without the mark in front."""
    sizes = model.out_sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    data = model.out_bytes[spread(model.out_at[ids], sizes)] if len(ids) else np.zeros(0, np.uint8)
    if model.dummy_prefix:
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        data = np.delete(data, ends[:-1][full])
        ends = ends - np.concatenate([[0], np.cumsum(bounds[1:] > bounds[:-1])])
    return data, ends


def _row_keys(keys: pa.Array) -> np.ndarray:
    return keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def encode(docs: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, dropout: float = 0.1) -> DataFrame:
    """id, ids (array of piece ids), n_pieces and lossless (the ids decode to the very text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, ENCODED_BYTES):
            ids, bounds = encode_column(shared.value, batch.column(1), _row_keys(batch.column(2)), seed=seed, dropout=dropout)
            data, ends = decode_column(shared.value, ids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(np.diff(bounds)), pa.array(_equal(batch.column(1), data, ends))], ["id", "ids", "n_pieces", "lossless"])

    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("key"))
    return read.mapInArrow(thrifty(run), f"id {read.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


def _equal(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each decoded text is the original's bytes."""
    same = np.zeros(len(texts), bool)
    for piece in pieces(texts):
        lo, hi = ends[piece.first], ends[piece.last]
        sizes_ok = np.diff(ends[piece.first : piece.last + 1]) == np.diff(piece.bounds)
        if sizes_ok.all():
            wrong = np.flatnonzero(data[lo:hi] != piece.data)
            bad = np.searchsorted(piece.bounds, wrong, "right") - 1
            ok = np.ones(len(sizes_ok), bool)
            ok[bad] = False
        else:
            ok = np.array([data[ends[piece.first + k] : ends[piece.first + k + 1]].tobytes() == piece.data[piece.bounds[k] : piece.bounds[k + 1]].tobytes() for k in range(len(sizes_ok))])
        same[piece.first : piece.last] = ok
    return same


def decode(encoded: DataFrame, model: PieceModel, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of encoded rows (null ids lists decode to the empty text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            data, ends = decode_column(shared.value, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], ["id", "text"])

    read = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return read.mapInArrow(thrifty(run), f"id {read.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
