"""Benchmark decontamination: an FM-index over each training shard, searched for test phrases.

A shard is about ``SHARD_BYTES`` of the texts that a task reads, all words of them, each text followed
by a separator.  ``index_shards`` builds the indexes once and keeps them in the shared folder, about
as large as the texts; a search reads them alone and never the texts, so a further benchmark, or a
further block of phrases, costs no more tokenising and sorting.  Each phrase is a backward search
through wavelet-tree ranks, its occurrences are placed by sampled suffix positions, and overlapping
occurrences merge into spans, which ``cut_benchmark_text`` removes.

No shuffle but for the rows to remove: a document's result depends on itself and on the test phrases.
Those are a stated query set: they are sent to the tasks in blocks of at most ``block_words`` words,
one block at a time in the driver and the tasks.

Defined results: a null or wordless text has no words, no spans and is not contaminated; null or
wordless items have no window; words of an item of null id are hit, but it is not among the items;
items that repeat an id count as one; an empty benchmark or empty documents give empty hits; a null
id is carried through; rows that repeat an id are each judged.  Columns besides id and text are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex, from_bytes, to_bytes
from .shared import stored, thrifty
from .text_arrays import ALNUM, FIRST, pieces, row_slices, spread, words

#: Test phrases are sent to the tasks in blocks of so many words at most.
BLOCK_WORDS = 500_000
#: Text of a shard.
SHARD_BYTES = 8 << 20
#: Rows to remove that may be sent to the tasks (16 bytes each, and the id).
SENT_ROWS = 500_000


class Phrases:
    """Distinct windows of test items, as rows of vocabulary numbers, with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        texts = pa.array([t for _, t in items], pa.string())
        self.items = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(texts):
            starts, ends, n = words(piece, ALNUM)
            hashes.append(FIRST.ranges(piece.data, starts, ends))
            counts.append(n)
        self.vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = np.concatenate(counts)
        owner = np.array([number.get(i, -1) for i, _ in items], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(sizes, window)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, window) == length)
            if not length:
                continue
            per_item = sizes[mine] - length + 1
            rows = ids[spread(begins[mine], per_item)[:, None] + np.arange(length)].astype(np.int32)
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            own = np.repeat(owner[mine], per_item)
            pairs = np.unique(which.ravel()[own >= 0] * max(len(self.items), 1) + own[own >= 0])
            held = np.bincount(pairs // max(len(self.items), 1), minlength=len(rows))
            self.groups.append((rows, np.concatenate([[0], np.cumsum(held)]), pairs % max(len(self.items), 1)))


class Shard:
    """The words of some texts as an FM-index, with the words' hashes and where each text begins."""

    def __init__(self, vocabulary: np.ndarray, begins: np.ndarray, index: FMIndex) -> None:
        self.vocabulary, self.begins, self.index = vocabulary, begins, index

    @classmethod
    def of(cls, column: pa.Array) -> Shard:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(column):
            starts, ends, n = words(piece, ALNUM)
            hashes.append(FIRST.ranges(piece.data, starts, ends))
            counts.append(n)
        vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = np.concatenate(counts)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        symbols = np.zeros(int(begins[-1]), np.int64)
        symbols[spread(begins[:-1], sizes)] = ids + 1
        return cls(vocabulary, begins, FMIndex.of(symbols, len(vocabulary) + 1))

    def to_bytes(self) -> bytes:
        return to_bytes([self.vocabulary, self.begins, *self.index.arrays()])

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> Shard:
        vocabulary, begins, *index = from_bytes(data)
        return cls(vocabulary, begins, FMIndex.from_arrays(index))

    def find(self, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each text: words, and hit spans as (text, begin, end); of all: (text, item) pairs as two arrays."""
        n_words = np.diff(self.begins) - 1
        edges = np.zeros(int(self.begins[-1]) + 1, np.int64)
        texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.vocabulary) and len(phrases.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
            number = np.where(self.vocabulary[at] == phrases.vocabulary, at + 1, 0)
            for rows, bounds, owners in phrases.groups:
                own = number[rows]
                known = np.flatnonzero((own > 0).all(1))
                low, high = self.index.search(own[known])
                sizes = high - low
                which = known[np.repeat(np.arange(len(known)), sizes)]
                places = self.index.locate(spread(low, sizes))
                np.add.at(edges, places, 1)
                np.add.at(edges, places + rows.shape[1], -1)
                held = bounds[which + 1] - bounds[which]
                texts.append(np.repeat(np.searchsorted(self.begins, places, "right") - 1, held))
                items.append(owners[spread(bounds[which], held)])
        hit = np.cumsum(edges[:-1]) > 0  # never at a separator, so that no run crosses one
        a = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]])[: len(hit)])
        b = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])[: len(hit)]) + 1
        text = np.searchsorted(self.begins, a, "right") - 1
        size = max(len(phrases.items), 1)
        pairs = np.unique(np.concatenate(texts) * size + np.concatenate(items))
        return n_words, [text, a - self.begins[text], b - self.begins[text]], pairs // size, pairs % size


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
HITS = "n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<string>"


def _text_key(text_col: str) -> Column:
    """A number of the text, which with the id tells a row's result."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def index_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, rows, index): the indexes of all texts, written to the shared folder; ``rows`` has the id and a key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, SHARD_BYTES):
            rows = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), rows, pa.array([Shard.of(batch.column(1)).to_bytes()], pa.binary())], ["shard", "rows", "index"])

    read = docs.select(F.struct(F.col(id_col).alias("id"), _text_key(text_col).alias("key")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["row"].dataType.simpleString()
    return stored(read.mapInArrow(thrifty(run), f"shard string, rows array<{kind}>, index binary"), "fm-index")


def _search(indexes: DataFrame, phrases: Phrases, hits_only: bool) -> tuple[DataFrame, object]:
    """(row, shard, place, hits) of every text, or of those with a hit; and the broadcast behind it."""
    shared = indexes.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows, data = batch.column(1)[k].values, batch.column(2)[k].as_buffer()
                n_words, (row, begin, end), pair_row, pair_item = Shard.from_bytes(memoryview(data)).find(shared.value)
                n = len(n_words)
                n_hit = np.bincount(row, end - begin, minlength=n).astype(np.int64)
                cut = lambda of, n=n: pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                spans = pa.ListArray.from_arrays(cut(row), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], fields=list(_SPAN)))
                items = pa.ListArray.from_arrays(cut(pair_row), pa.array(shared.value.items, pa.string()).take(pa.array(pair_item, pa.int64())))
                out = pa.RecordBatch.from_arrays([rows, pa.repeat(batch.column(0)[k], n), pa.array(np.arange(n)), pa.array(n_words, pa.int64()), pa.array(n_hit), spans, items], ["row", "shard", "place", "n_words", "n_hit", "spans", "items"])
                yield out.filter(pa.array(n_hit > 0)) if hits_only else out

    kind = indexes.schema["rows"].dataType.elementType.simpleString()
    return indexes.select("shard", "rows", "index").mapInArrow(thrifty(run), f"row {kind}, shard string, place long, {HITS}"), shared


def contaminated(n_words: Column, n_hit: Column, one_in: int = 20) -> Column:
    """The contamination rule: at least one hit word, and at least one word of ``one_in`` hit."""
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """Test items in blocks of at most ``block_words`` words (a longer item is one block)."""
    held: list[tuple[str | None, str]] = []
    size = 0
    for item, text in benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        n = len(text) // 2 + 1
        if held and size + n > block_words:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, text))
        size += n
    yield Phrases(held, window)


def search(indexes: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, n_hit, spans, items) of every text of ``index_shards``' indexes.

    ``window`` consecutive item words make a phrase; a shorter item is one phrase.
    """
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(indexes, first, False)[0].drop("shard", "place")
    every = stored(_search(indexes, first, False)[0], "hits")
    parts = [every.filter("n_hit > 0").select("shard", "place", "spans", "items")]
    del first
    while second is not None:
        made, shared = _search(indexes, second, True)
        parts.append(stored(made.select("shard", "place", "spans", "items"), "hits"))
        shared.destroy()
        second = next(blocks, None)
    # a text has at most one row a block
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = reduce(DataFrame.unionByName, parts).groupBy("shard", "place").agg(joined("spans"), joined("items"))
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["begin"].alias("begin"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    union = F.aggregate("spans", F.expr("cast(array() as array<struct<begin:long,end:long>>)"), lambda done, s: F.when((F.size(done) > 0) & (last(done)["end"] >= s["begin"]), longer(done, s)).otherwise(F.concat(done, F.array(s))))
    merged = merged.select("shard", "place", union.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    whole = every.select("row", "shard", "place", "n_words").join(merged, ["shard", "place"], "left")
    none = lambda c: F.coalesce(F.col(c), F.expr(f"cast(array() as {every.schema[c].dataType.simpleString()})"))
    return whole.select("row", "n_words", none("spans").alias("spans"), none("items").alias("items")).select("row", "n_words", n_hit.alias("n_hit"), "spans", "items")


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: id, n_words, n_hit, spans (word positions, end exclusive), items (sorted ids)."""
    found = search(index_shards(docs, id_col=id_col, text_col=text_col), benchmark, **how)
    return found.select(F.col("row.id").alias(id_col), "n_words", "n_hit", "spans", "items")


def _beside(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, kind: str) -> tuple[DataFrame, list[str]]:
    """``docs`` joined by id and text with ``rows`` (row, ...), one a key; with the names that docs' columns have there."""
    rows = stored(rows, "rows").withColumns({"_id": F.col("row.id"), "_key": F.col("row.key")}).drop("row")
    names = [f"c{k}" for k in range(len(docs.columns))]  # no name of the documents' columns can clash
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = F.broadcast(rows) if rows.count() <= SENT_ROWS else rows
    return docs.toDF(*names).join(rows, F.col(own_id).eqNullSafe(F.col("_id")) & (_text_key(own_text) == F.col("_key")), kind), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_in: int = 20, **how) -> DataFrame:
    """The documents that the contamination rule leaves, all columns as they are."""
    found = search(index_shards(docs, id_col=id_col, text_col=text_col), benchmark, **how)
    bad = found.filter(contaminated(F.col("n_words"), F.col("n_hit"), one_in)).select("row").distinct()
    return _beside(docs, bad, id_col, text_col, "left_anti")[0].toDF(*docs.columns)


def cut_benchmark_text(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the spans found: from a span's first word to its last, what is between included."""
    found = search(index_shards(docs, id_col=id_col, text_col=text_col), benchmark, **how)
    hits = found.filter("n_hit > 0").groupBy("row").agg(F.first("spans").alias("_spans"))  # equal rows have equal spans
    joined, names = _beside(docs, hits, id_col, text_col, "left")
    position = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, position, SHARD_BYTES):
            texts, spans = batch.column(position).to_pylist(), batch.column(len(names)).to_pylist()
            for k in [k for k, s in enumerate(spans) if s]:
                piece = next(pieces(batch.column(position)[k : k + 1]))
                starts, ends, _ = words(piece, ALNUM)
                raw, kept, at = piece.data.tobytes(), [], 0
                for s in spans[k]:
                    kept.append(raw[at : starts[s["begin"]]])
                    at = int(ends[s["end"] - 1])
                texts[k] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            columns = batch.columns[: len(names)]
            columns[position] = pa.array(texts, columns[position].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    made = joined.select(*names, "_spans")
    return made.mapInArrow(thrifty(cut), made.select(*names).schema).toDF(*docs.columns)
