"""Ranked lexical search by Block-Max WAND over an inverted index in shards.

``index`` cuts the documents into shards of about ``SHARD_BYTES`` of text, numbered by id within a
shard.  A term's postings are blocks of 128: numbers as gaps and frequencies, each in as many bits as
the block needs, and beside them, uncompressed, the block's first and last number and its maximum
impact.  ``search`` moves over these heads alone: at every number the maxima of the blocks that
cover it, times their terms' weights, bound the score there.  Ranges are taken by falling bounds; only
blocks that reach into a range whose bound is not under the k-th best score so far are decompressed,
and a task's k-th best score is carried from shard to shard.  A block of a rare term says little over the
many numbers it spans, so the few postings of such blocks are read at once and bound exactly.

The impact of a term that a document of n terms holds tf times is, in whole numbers,

    (1000000000 * tf) div (1000 * tf + k1 * m),  m = 100 - b + (b * n * N) div L

(N: documents with a term, L: all their terms), its weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

At size: the texts are read twice (N and L first) and moved never; the index is written once, about
two thirds as large as the texts; a task gives at most k rows an item and holds one shard.  Items are a
stated query set: they go to the tasks in blocks of at most ``block_terms`` words, each a pass over
the shards' terms and one over the index.

Terms are known by a 64-bit hash: a word of the corpus is taken for a word of the items if the hashes
agree, which over 10^9 different words and 10^4 words of the items is expected 10^-6 times.

Defined results: null texts and texts without terms are in no result; documents and items of a null
id take no part; rows that repeat a document's id are documents of their own; of rows that repeat an
item's id the smallest text counts; an item without terms, or without a document that scores above 0,
has no rows; ties go to the smaller id; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fm_index import from_bytes, to_bytes
from .shared import stored
from .text_arrays import ALNUM, FIRST, pieces, row_slices, spread, words

#: Text of a shard.
SHARD_BYTES = 16 << 20
#: Postings of a block.
BLOCK = 128
#: Words of the items that are sent to the tasks at once.
BLOCK_TERMS = 500_000
#: A block that spans more than so many numbers a posting is read at once.
SPARSE = 16
#: Documents whose range of bounds is looked at first; each further step takes twice as many.
FIRST_STEP = 16


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # exact under 2**53


class Packed(NamedTuple):
    """Runs of whole numbers, each run in bits of its own width."""

    bits: np.ndarray
    at: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> Packed:
        bits = _bit_lengths(np.maximum.reduceat(values, firsts)) if len(firsts) else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum((sizes * bits + 7) // 8)])
        flat = np.zeros(8 * int(at[-1]), np.uint8)
        for width in np.unique(bits[bits > 0]).tolist():
            which = np.flatnonzero(bits == width)
            own = values[spread(firsts[which], sizes[which])]
            place = np.repeat(8 * at[which], sizes[which]) + width * spread(np.zeros(len(which), np.int64), sizes[which])
            for k in range(width):
                flat[place + k] = (own >> (width - 1 - k)) & 1
        return cls(bits, at, np.packbits(flat))

    def get(self, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of some runs, one run after the other."""
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        bits = self.bits[which]
        for width in np.unique(bits[bits > 0]).tolist():
            mine = np.flatnonzero(bits == width)
            n_bytes = self.at[which[mine] + 1] - self.at[which[mine]]
            flat = np.unpackbits(self.data[spread(self.at[which[mine]], n_bytes)])
            starts = 8 * np.concatenate([[0], np.cumsum(n_bytes)[:-1]])
            place = np.repeat(starts, sizes[mine]) + width * spread(np.zeros(len(mine), np.int64), sizes[mine])
            value = np.zeros(len(place), np.int64)
            for k in range(width):
                value = (value << 1) | flat[place + k]
            out[spread(ends[mine] - sizes[mine], sizes[mine])] = value
        return out


class Shard:
    """The postings of some documents, which are numbered by rising id."""

    def __init__(self, vocabulary: np.ndarray, blocks: np.ndarray, m: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, top: np.ndarray, gaps: Packed, counts: Packed, k1: int) -> None:
        self.vocabulary, self.blocks, self.m, self.first, self.last, self.size, self.top = vocabulary, blocks, m, first, last, size, top
        self.gaps, self.counts, self.k1 = gaps, counts, k1

    @classmethod
    def of(cls, column: pa.Array, n_docs: int, n_terms: int, k1: int, b: int) -> tuple[Shard, np.ndarray]:
        """The shard of texts in the order of their ids, and the documents a term."""
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(column):
            starts, ends, n = words(piece, ALNUM)
            hashes.append(FIRST.ranges(piece.data, starts, ends))
            rows.append(np.repeat(np.arange(piece.first, piece.last), n))
        vocabulary, term = np.unique(np.concatenate(hashes), return_inverse=True)
        row, n = np.concatenate(rows), max(len(column), 1)
        m = length_rates(np.bincount(row, minlength=len(column)), n_docs, n_terms, b)
        key, count = np.unique(term * n + row, return_counts=True)
        term, doc = np.divmod(key, n)
        df = np.bincount(term, minlength=len(vocabulary))
        begins = np.concatenate([[0], np.cumsum(df)])
        place = np.arange(len(term)) - begins[term]
        at = np.flatnonzero(place % BLOCK == 0)
        size = np.diff(np.append(at, len(term)))
        gaps = np.zeros(len(doc), np.int64)
        gaps[1:] = doc[1:] - doc[:-1] - 1
        gaps[at] = 0
        top = np.maximum.reduceat(impacts(count, m[doc], k1), at) if len(at) else at
        blocks = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        return cls(vocabulary, blocks, m, doc[at], doc[at + size - 1] if len(at) else at, size, top, Packed.of(gaps, at, size), Packed.of(count - 1, at, size), k1), df

    def to_bytes(self) -> bytes:
        return to_bytes([self.blocks.astype(np.int32), self.m, *(x.astype(np.int32) for x in (self.first, self.last, self.size, self.top)), *self.gaps, *self.counts])

    @classmethod
    def from_bytes(cls, vocabulary: np.ndarray, data: memoryview, k1: int) -> Shard:
        blocks, m, first, last, size, top, *packed = from_bytes(data)
        return cls(vocabulary, blocks.astype(np.int64), m, first.astype(np.int64), last.astype(np.int64), size.astype(np.int64), top.astype(np.int64), Packed(*packed[:3]), Packed(*packed[3:]), k1)

    def postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and impacts of the postings of some blocks, decompressed."""
        sizes = self.size[which]
        steps = self.gaps.get(which, sizes) + 1
        begins = np.cumsum(sizes) - sizes
        run = np.cumsum(steps)
        doc = run - np.repeat(run[begins], sizes) + np.repeat(self.first[which], sizes)
        return doc, impacts(self.counts.get(which, sizes) + 1, self.m[doc], self.k1)

    def search(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``best`` and this shard's documents, as (score, id), for terms of the shard."""
        n_blocks = self.blocks[terms + 1] - self.blocks[terms]
        which, weight = spread(self.blocks[terms], n_blocks), np.repeat(weights, n_blocks)
        scores = np.zeros(len(self.m), np.int64)
        sparse = self.last[which] - self.first[which] >= SPARSE * self.size[which]
        exact, impact = self.postings(which[sparse])
        impact *= np.repeat(weight[sparse], self.size[which[sparse]])
        np.add.at(scores, exact, impact)
        which, weight = which[~sparse], weight[~sparse]
        first, after, bound = self.first[which], self.last[which] + 1, self.top[which] * weight
        edges, at = np.unique(np.concatenate([first, exact, after, exact + 1]), return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, at, np.concatenate([bound, impact, -bound, -impact]))
        reach = np.cumsum(change)[:-1]  # the most a document of edges[i] .. edges[i + 1] - 1 can score
        order = np.argsort(-reach, kind="stable")
        docs_up_to = np.cumsum(np.diff(edges)[order])
        read = np.zeros(len(which), bool)
        done, step = 0, FIRST_STEP
        while done < len(order):
            least = best[0][-1] if len(best[0]) == k else 1
            live = int(np.searchsorted(-reach[order], -least, "right"))  # ranges from here on are under it
            end = min(live, int(np.searchsorted(docs_up_to, (docs_up_to[done - 1] if done else 0) + step)) + 1)
            if end <= done:
                break
            ranges = order[done:end]
            docs = spread(edges[ranges], edges[ranges + 1] - edges[ranges])
            inside = np.zeros(len(self.m) + 1, np.int64)
            inside[docs + 1] = 1
            inside = np.cumsum(inside)
            need = np.flatnonzero(~read & (inside[after] > inside[first]))
            read[need] = True
            number, impact = self.postings(which[need])
            np.add.at(scores, number, impact * np.repeat(weight[need], self.size[which[need]]))
            docs = docs[scores[docs] >= least]
            best = merged(best, (scores[docs], ids[docs]), k)
            done, step = end, 2 * step
        return best


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both: higher scores, then smaller ids."""
    score, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def length_rates(n: np.ndarray, n_docs: int, n_terms: int, b: int) -> np.ndarray:
    """m of documents of n terms."""
    if not n_terms:
        return np.full(len(n), 100 - b)
    if b * int(n.max(initial=0)) * n_docs < 2**63:
        return 100 - b + b * n.astype(np.int64) * n_docs // n_terms
    return np.array([100 - b + b * x * n_docs // n_terms for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray, k1: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + k1 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k1: int = 8, b: int = 90) -> DataFrame:
    """(n_docs, k1, ids, terms, postings) a shard, written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for piece in pieces(batch.column(1)):
                _, _, n = words(piece, ALNUM)
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], ["n_docs", "n_terms"])

    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = read.mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    n_docs, n_terms = total.n_docs or 0, total.n_terms or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, SHARD_BYTES):
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            shard, df = Shard.of(batch.column(1), n_docs, n_terms, k1, b)
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            terms = to_bytes([shard.vocabulary, df.astype(np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([k1], pa.int32()), ids, pa.array([terms], pa.binary()), pa.array([shard.to_bytes()], pa.binary())], ["n_docs", "k1", "ids", "terms", "postings"])

    return stored(read.mapInArrow(build, "n_docs long, k1 int, ids array<long>, terms binary, postings binary"), "block-max")


class Items(NamedTuple):
    """Items' distinct terms: ``terms[begins[i] : begins[i + 1]]`` are the vocabulary numbers of item i."""

    ids: list
    vocabulary: np.ndarray
    begins: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str]]) -> Items:
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(pa.array([t for _, t in rows], pa.string())):
            starts, ends, n = words(piece, ALNUM)
            hashes.append(FIRST.ranges(piece.data, starts, ends))
            owner.append(np.repeat(np.arange(piece.first, piece.last), n))
        vocabulary, term = np.unique(np.concatenate(hashes), return_inverse=True)
        size = max(len(vocabulary), 1)
        own, terms = np.divmod(np.unique(np.concatenate(owner) * size + term), size)
        return cls([i for i, _ in rows], vocabulary, np.searchsorted(own, np.arange(len(rows) + 1)), terms)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[Items]:
    """The items in blocks of about ``block_terms`` words at most (a longer item is one block)."""
    rows = items.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(text_col).cast("string")).alias("text"))
    held, size = [], 0
    for item, text in rows.filter(F.col("text").isNotNull()).toLocalIterator():
        n = len(text) // 2 + 1
        if held and size + n > block_terms:
            yield Items.of(held)
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield Items.of(held)


def _in_shard(vocabulary: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The numbers of the wanted terms in a shard, -1 for those that it lacks."""
    if not len(vocabulary):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, wanted), len(vocabulary) - 1)
    return np.where(vocabulary[at] == wanted, at, -1)


def document_counts(shards: DataFrame, block: Items) -> np.ndarray:
    """In how many documents each term of the block is: reads the shards' terms alone."""
    wanted = shards.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for terms in batch.column(0):
                vocabulary, df = from_bytes(memoryview(terms.as_buffer()))
                at = _in_shard(vocabulary, wanted.value)
                total[at >= 0] += df[at[at >= 0]]
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(total[which])], ["term", "df"])

    out = np.zeros(len(block.vocabulary), np.int64)
    for row in shards.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        out[row.term] = row.df
    wanted.destroy()
    return out


def _search_block(shards: DataFrame, block: Items, n_docs: int, k: int):
    """(item, doc_id, score): each task's k best of each item, by the item's number; and the broadcast behind it."""
    weights = np.array([weight(n_docs, int(x)) for x in document_counts(shards, block)], np.int64)
    shared = shards.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(block.ids)
        for batch in batches:
            for k1, ids, terms, data in zip(*batch.columns, strict=True):
                vocabulary, _ = from_bytes(memoryview(terms.as_buffer()))
                shard = Shard.from_bytes(vocabulary, memoryview(data.as_buffer()), k1.as_py())
                own_ids, at = ids.values.to_numpy(), _in_shard(vocabulary, block.vocabulary)
                for item in range(len(block.ids)):
                    mine = block.terms[block.begins[item] : block.begins[item + 1]]
                    mine = mine[(at[mine] >= 0) & (weights[mine] > 0)]
                    if len(mine):
                        best[item] = shard.search(own_ids, at[mine], weights[mine], best[item], k)
        sizes = [len(score) for score, _ in best]
        columns = [np.repeat(np.arange(len(best)), sizes), np.concatenate([none, *(i for _, i in best)]), np.concatenate([none, *(s for s, _ in best)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return shards.select("k1", "ids", "terms", "postings").mapInArrow(run, "item long, doc_id long, score long"), shared


def search(shards: DataFrame, items: DataFrame, *, k: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``index``'s shards for each item."""
    spark = shards.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    found = shards.select("n_docs").first()
    blocks = item_blocks(items, item_col, item_text_col, block_terms) if found else iter(())
    parts, block = [], next(blocks, None)
    while block is not None:
        later = next(blocks, None)
        rows, shared = _search_block(shards, block, found.n_docs, k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, {item_col} {kind}")
        named = rows.join(F.broadcast(names), "item").select(item_col, "doc_id", "score")
        if parts or later is not None:  # of more blocks, each is done before the next begins
            named = stored(named, "block-max-hits")
            shared.destroy()
        parts.append(named)
        block = later
    if not parts:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    best = Window.partitionBy(item_col).orderBy(F.col("score").desc(), "doc_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select(item_col, "rank", "doc_id", "score")
