"""Line dedup that can be undone: exact reference counts, with sharded cuckoo filters before them.

``LineStore`` is a folder of Parquet tables that batches append to and that can be opened again:

* ``postings``: (line key, document) of each distinct key of a document; ``deleted``: documents taken out;
* ``counts``: the exact reference count and the keeper (largest document) of each key.  A batch writes
  new rows for the keys it touches alone; the newest row of a key counts;
* ``filters``: a cuckoo filter a shard over the keys that ``min_docs`` documents hold.  Keys that a
  batch takes over or under that number are inserted into, or deleted from, their shards' filters; other
  shards are not touched.  A filter that gets too full is built anew, larger, from the counts.  Shards
  follow the keys: there are ``SHARD_KEYS`` to a shard at first, and when twice as many come to be held
  all filters are built anew with more shards, so that no task builds a large one;
* ``commits``: a small file a batch, made under the next number and never written over.  A batch counts
  once it is there, so a batch that failed leaves nothing behind; of two writers that began at one state
  the second is refused.

``apply`` sends the filters to the tasks in blocks of at most ``filter_bytes``, a pass over the lines
each, and only lines that pass them are looked up in the exact counts, which alone decide.  Beyond
``MOST_PASSES`` blocks all lines are looked up, by one shuffle, as it costs less than more passes.

Keys are two independent 64-bit hashes of the normalised line.  A key that a third of the
documents hold is counted by partial aggregation, and its join rows are split by adaptive
execution, as the table side has one row a key.

Defined results: a null or empty text is one empty line and stays; keys under ``min_chars`` code
points never count; rows with a null id keep all lines and count for none; rows that repeat an id
are one document.  Other columns are carried through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .shared import claim, exists, shared_dir, stored, thrifty
from .text_arrays import FIRST, SECOND, Lines, Piece, lines, pieces, row_slices

#: Filters that are sent to the tasks at once.
FILTER_BYTES = 64 << 20
#: Shards of the filters at least, and keys of a shard.
SHARDS, SHARD_KEYS = 64, 1 << 20
#: Passes over the lines at most.
MOST_PASSES = 4


def _keys(piece: Piece, own: Lines, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that count, by number, and their two keys."""
    which = np.flatnonzero(own.chars >= min_chars)
    ranges = own.key_starts[which], own.key_ends[which]
    return which, FIRST.ranges(piece.data, *ranges).view(np.int64), SECOND.ranges(piece.data, *ranges).view(np.int64)


def postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int, filters=None, shards: int = SHARDS) -> DataFrame:
    """(k1, k2, doc) of each distinct line key of a document; with filters, of those that pass them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = filters and {shard: CuckooFilter.from_bytes(x) for shard, x in filters.value.items()}
        for batch in batches:
            ids = batch.column(0)
            for piece in pieces(batch.column(1)):
                own = lines(piece)
                which, k1, k2 = _keys(piece, own, min_chars)
                row = own.row[which]
                if sieve is not None:
                    shard = k1 % shards
                    held = np.zeros(len(k1), bool)
                    for s in sieve:
                        mine = np.flatnonzero(shard == s)
                        held[mine] = sieve[s].contains(k1[mine])
                    row, k1, k2 = row[held], k1[held], k2[held]
                order = np.lexsort((k2, k1, row))
                row, k1, k2 = row[order], k1[order], k2[order]
                new = np.ones(len(order), bool)
                new[1:] = (row[1:] != row[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(k2[new]), ids.take(pa.array(row[new] + piece.first))], ["k1", "k2", "doc"])

    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(thrifty(run), f"k1 long, k2 long, doc {read.schema['doc'].dataType.simpleString()}")


class LineStore:
    """The lines of all documents that were inserted and not deleted, under one folder.

    A ``path`` that holds a store opens it; its settings must be those it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, shards: int = SHARDS, filter_bytes: int = FILTER_BYTES) -> None:
        self.spark, self.root = spark, path or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.id_col, self.text_col, self.filter_bytes = id_col, text_col, filter_bytes
        self.min_chars, self.min_docs, self.least_shards, self.shards, self.since, self.n_repeated = min_chars, min_docs, shards, shards, 1, 0
        self.version, self.token, self.writers = 0, uuid.uuid4().hex, []
        while (text := claim(spark, f"{self.root}/commits/{self.version + 1}")) is not None:
            state = json.loads(text)
            if (state["min_chars"], state["min_docs"]) != (min_chars, min_docs):
                raise ValueError(f"the store at {self.root} was made with other settings")
            self.version, self.shards, self.since, self.n_repeated = self.version + 1, state["shards"], state["since"], state["n_repeated"]
            self.writers.append(state["writer"])

    def _table(self, kind: str, since: int = 1) -> DataFrame | None:
        """The committed rows of a table, with the batch that wrote them as ``v``."""
        if not self.version or not exists(self.spark, f"{self.root}/{kind}"):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{kind}")
        return rows.filter(F.col("v").between(since, self.version) & F.col("writer").isin(self.writers)).drop("writer")

    def _write(self, rows: DataFrame, kind: str, v: int) -> DataFrame:
        path = f"{self.root}/{kind}/v={v}/writer={self.token}"
        rows.write.mode("overwrite").parquet(path)  # what this writer left of an attempt that failed
        return self.spark.read.parquet(path)

    def _commit(self, v: int) -> LineStore:
        state = {"min_chars": self.min_chars, "min_docs": self.min_docs, "shards": self.shards, "since": self.since, "n_repeated": self.n_repeated, "writer": self.token}
        if claim(self.spark, f"{self.root}/commits/{v}", json.dumps(state)) is not None:
            raise RuntimeError(f"another writer has changed the store at {self.root}: open it again and repeat the batch")
        self.version = v
        self.writers.append(self.token)
        return self

    def postings(self) -> DataFrame | None:
        """(k1, k2, doc) of the documents that are in the store."""
        every, deleted = self._table("postings"), self._table("deleted")
        if every is None or deleted is None:
            return None if every is None else every.select("k1", "k2", "doc")
        gone = deleted.groupBy("doc").agg(F.max("v").alias("gone"))
        return every.join(gone, "doc", "left").filter(F.col("gone").isNull() | (F.col("v") > F.col("gone"))).select("k1", "k2", "doc")

    def insert(self, docs: DataFrame) -> LineStore:
        """Adds documents; those whose id is there already add nothing new for lines they had."""
        v = self.version + 1
        new = postings(docs, self.id_col, self.text_col, self.min_chars).distinct()
        held, old = self.postings(), self.counts()
        if held is not None:
            new = new.join(held, ["k1", "k2", "doc"], "left_anti")
        new = self._write(new, "postings", v)
        touched = new.groupBy("k1", "k2").agg(F.count("*").alias("more"), F.max("doc").alias("top"))
        if old is None:
            changed = touched.select("k1", "k2", F.col("more").alias("n_docs"), F.col("top").alias("keeper"), F.lit(0).cast("long").alias("before"))
        else:
            before = F.coalesce("n_docs", F.lit(0))
            changed = touched.join(old, ["k1", "k2"], "left").select("k1", "k2", (before + F.col("more")).alias("n_docs"), F.greatest("keeper", "top").alias("keeper"), before.cast("long").alias("before"))
        self._update_filters(self._write(changed, "counts", v), v)
        return self._commit(v)

    def delete(self, ids: DataFrame) -> LineStore:
        """Takes out the documents whose ids are in the first column."""
        held, old = self.postings(), self.counts()
        if held is None:
            return self
        v = self.version + 1
        gone = ids.select(F.col(ids.columns[0]).alias("doc")).dropna().distinct()
        less = stored(held.join(gone, "doc", "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("less")), "less")
        rest = held.join(gone, "doc", "left_anti").join(less, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc").alias("top"))
        changed = less.join(old, ["k1", "k2"]).join(rest, ["k1", "k2"], "left").select("k1", "k2", (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("top").alias("keeper"), F.col("n_docs").alias("before"))
        changed = self._write(changed, "counts", v)
        self._write(gone, "deleted", v)
        self._update_filters(changed, v)
        return self._commit(v)

    def counts(self) -> DataFrame | None:
        """The exact reference counts: k1, k2, n_docs, keeper (the largest document id)."""
        rows = self._table("counts")
        if rows is None:
            return None
        if self.version > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "keeper"), "v").alias("x")).select("k1", "k2", "x.*")
        return rows.filter("n_docs > 0").select("k1", "k2", "n_docs", "keeper")

    def repeated(self) -> DataFrame:
        return self.counts().filter(F.col("n_docs") >= self.min_docs)

    def filters(self) -> DataFrame:
        """(shard, filter): the newest filter of each shard that has one."""
        return self._table("filters", self.since).groupBy("shard").agg(F.max_by("filter", "v").alias("filter"))

    def _update_filters(self, changed: DataFrame, v: int) -> None:
        """Takes the keys of a batch that came to ``min_docs``, or fell under it, into or out of their shards' filters."""
        up, was = F.col("n_docs") >= self.min_docs, F.col("before") >= self.min_docs
        crossed = changed.filter(up != was).select("k1", up.alias("up"))
        self.n_repeated += crossed.agg(F.coalesce(F.sum(F.when(F.col("up"), 1).otherwise(-1)), F.lit(0)).alias("n")).first().n
        if not self.version or self.n_repeated > 2 * SHARD_KEYS * self.shards:
            self.shards, self.since = max(self.least_shards, -(-self.n_repeated // SHARD_KEYS)), v  # filters of other shards count no longer
        shard = F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")

        def build(group: pa.Table) -> pa.Table:
            return pa.table({"shard": group.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.of(group.column("k1").to_numpy(), room=2).to_bytes()], pa.binary())})

        def anew() -> DataFrame:
            """(shard, k1) of all keys with this batch, whose counts are written."""
            version, self.version = self.version, v
            self.writers.append(self.token)
            keys = self.repeated().select(shard, "k1")
            self.version = version
            self.writers.pop()
            return keys

        if self.since == v and self.version:
            self._write(anew().groupBy("shard").applyInArrow(build, "shard int, filter binary"), "filters", v)
            return
        empty = self.spark.createDataFrame([], "shard int, filter binary")
        old = self.filters() if self._table("filters") is not None else empty

        def update(keys: pa.Table, held: pa.Table) -> pa.Table:
            if not len(keys):
                return pa.table({"shard": held.column("shard").slice(0, 0), "filter": held.column("filter").slice(0, 0)})
            k1, ups = keys.column("k1").to_numpy(), keys.column("up").to_numpy(zero_copy_only=False)
            now = None
            if len(held):
                now = CuckooFilter.from_bytes(held.column("filter")[0].as_py(), writable=True)
                now.delete(k1[~ups])
                now = now if now.insert(k1[ups]) else None  # None: too full
            else:
                now = CuckooFilter.of(k1[ups])
            return pa.table({"shard": keys.column("shard").slice(0, 1), "filter": pa.array([now and now.to_bytes()], pa.binary())})

        made = self._write(crossed.select(shard, "k1", "up").groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(update, "shard int, filter binary"), "updates", v)
        full = made.filter("filter is null").select("shard")
        if not full.isEmpty():
            rebuilt = anew().join(F.broadcast(full), "shard", "left_semi")  # a row a shard at most
            made = made.filter("filter is not null").unionByName(rebuilt.groupBy("shard").applyInArrow(build, "shard int, filter binary"))
        self._write(made, "filters", v)

    def apply(self, docs: DataFrame, *, counts: bool = True) -> DataFrame:
        """``docs`` with the text cut; with ``counts`` also n_lines and n_dropped as the last columns,
        which replace columns of these names."""
        repeated, filters = self.repeated(), self.filters()
        blocks: list[list[int]] = [[]]
        size = 0
        for shard, n in sorted(filters.select("shard", F.length("filter")).collect()):  # a row of two numbers a shard
            if blocks[-1] and size + n > self.filter_bytes:
                blocks.append([])
                size = 0
            blocks[-1].append(shard)
            size += n
        parts = []
        if len(blocks) > MOST_PASSES:
            parts, blocks = [postings(docs, self.id_col, self.text_col, self.min_chars)], []
        for block in blocks:  # one block at a time in the driver and the tasks
            shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters.filter(F.col("shard").isin(block)).toLocalIterator()})
            parts.append(postings(docs, self.id_col, self.text_col, self.min_chars, shared, self.shards))
            if len(blocks) > 1:
                parts[-1] = stored(parts[-1], "candidates")
                shared.destroy()
        candidates = reduce(DataFrame.unionByName, parts)
        dropped = candidates.join(repeated, ["k1", "k2"]).filter(F.col("doc") != F.col("keeper")).groupBy("doc").agg(F.collect_set(F.struct("k1", "k2")).alias("_dropped")).select(F.col("doc").alias("_doc"), "_dropped")
        position, width, min_chars = docs.columns.index(self.text_col), len(docs.columns), self.min_chars
        names = [f"c{k}" for k in range(width)]
        numbered = docs.toDF(*names)  # no name of the documents' columns can clash
        joined = numbered.join(dropped.hint("shuffle_hash"), F.col(names[docs.columns.index(self.id_col)]) == F.col("_doc"), "left").drop("_doc")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in row_slices(batches, position, 8 << 20):
                text, n_lines, n_dropped = cut_lines(batch.column(position), batch.column(width), min_chars)
                columns = batch.columns[:width]
                columns[position] = text
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, joined.schema.fields, strict=False))
        made = joined.mapInArrow(thrifty(cut), f"{kinds}, n_lines long, n_dropped long")
        own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if not counts or c not in ("n_lines", "n_dropped")]
        return made.select(*own, *(["n_lines", "n_dropped"] if counts else []))


def cut_lines(texts: pa.Array, dropped: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the lines whose keys are in their list (a null text stays null)."""
    raw = texts.view(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())  # bytes, as they need not be valid UTF-8
    out: list[bytes | None] = []
    n_lines, n_dropped = [], []
    gone_at = np.flatnonzero(dropped.is_valid().to_numpy(zero_copy_only=False))
    for piece in pieces(texts):
        own = lines(piece)
        n = len(piece.bounds) - 1
        n_lines.append(np.bincount(own.row, minlength=n))
        cuts = np.zeros(n, np.int64)
        mine = gone_at[(gone_at >= piece.first) & (gone_at < piece.last)]
        new: dict[int, bytes] = {}
        if len(mine):
            which, k1, k2 = _keys(piece, own, min_chars)
            rows = own.row[which]
            bytes_ = piece.data.tobytes()
            first_line = np.searchsorted(own.row, np.arange(n + 1))
            for at in mine:
                r = int(at - piece.first)
                a, b = np.searchsorted(rows, [r, r + 1])
                held = dropped[int(at)].values
                keys = set(zip(held.field("k1").to_pylist(), held.field("k2").to_pylist(), strict=True))
                lose = {k for k, pair in zip(which[a:b].tolist(), zip(k1[a:b].tolist(), k2[a:b].tolist(), strict=True), strict=True) if pair in keys}
                cuts[r] = len(lose)
                new[r] = b"\n".join(bytes_[own.starts[k] : own.ends[k]] for k in range(first_line[r], first_line[r + 1]) if k not in lose)
        n_dropped.append(cuts)
        old = raw.slice(piece.first, n).to_pylist()
        for r, text in new.items():
            old[r] = text
        out += old
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.array(out, raw.type).view(texts.type), joined(n_lines), joined(n_dropped)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bytes: int = FILTER_BYTES, counts: bool = True) -> DataFrame:
    """One batch: all of ``docs`` inserted into a new store, which is then applied to them."""
    store = LineStore(docs.sparkSession, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, filter_bytes=filter_bytes)
    return store.insert(docs).apply(docs, counts=counts)
