"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(scale * x), and are dealt to partitions by length, longest first, so
that a partition holds a range of lengths; within it they form buckets of ``bucket`` vectors.  Each
query starts with a bound: its k-th best score among the ``probe`` longest vectors.  For a bucket
whose longest vector has length m, a query of length n needs a cosine of at least bound / (n * m):

* over 1, the bucket is skipped (length pruning);
* if the values of each query's largest coordinate that this cosine allows select few vectors, only
  those are multiplied (coordinate pruning);
* else the whole bucket is multiplied.

Products are exact and decide alone.  Bounds rise as a partition is read.

Queries go to the tasks in blocks of at most ``block_bytes``, one after the other; each block is one
pass over all vectors, so neither side is ever held whole.  A partition gives at most k rows a query.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor
do rows of a null id; shorter vectors count as padded with zeros; rows that repeat an id are each a
candidate, but of no query of that id, and queries that repeat an id share their k rows; fewer than k
others give fewer rows; an empty table gives none.  Products are whole numbers of any size; one that
a long cannot hold ends the query with an error, as no score could be returned for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .text_arrays import spread

BLOCK_BYTES = 16 << 20
PROBE = 2048
BUCKET = 512
#: Coordinate pruning is taken if it selects less than this share of a bucket's pairs.
SPARSE = 0.05


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, norm): v holds the whole numbers as little-endian doubles, which hold each of them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.cast(pa.float64())
            y = np.floor(values.to_numpy(zero_copy_only=False) * scale)  # a null is NaN here
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(y))])
            ok = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (wrong[bounds[1:]] == wrong[bounds[:-1]]))
            sizes = (bounds[1:] - bounds[:-1])[ok]
            y = y[spread(bounds[:-1][ok], sizes)]
            at = np.concatenate([[0], np.cumsum(sizes)])
            full = np.flatnonzero(sizes)
            norms = np.zeros(len(ok))
            norms[full] = np.sqrt(np.add.reduceat(y * y, at[:-1][full])) if len(full) else 0
            raw = pa.Array.from_buffers(pa.binary(), len(ok), [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(y.astype("<f8"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), raw, pa.array(norms)], ["id", "v", "norm"])

    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, v binary, norm double")


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded to ``width`` (longer ones are cut: their partners are zero there)."""
    _, offsets, data = rows.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(rows.type) else np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) // 8
    values = np.frombuffer(data, "<f8", int(at[-1])) if len(rows) and data is not None else np.zeros(0)
    if (np.diff(at) == width).all():
        return values[at[0] :].reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    sizes = np.minimum(np.diff(at), width)
    out[np.repeat(np.arange(len(rows)), sizes), spread(np.zeros(len(rows), np.int64), sizes)] = values[spread(at[:-1], sizes)]
    return out


def exact_products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of all rows: in doubles while they stay under 2**53, else in whole numbers of 64 bits or of any size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return q @ vectors.T
    if most < 2**62:
        return q.astype(np.int64) @ vectors.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).dot(whole(vectors).T)


def as_longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and len(scores) and max(-scores.min(), scores.max()) >= 2**63:
        raise OverflowError("an inner product is beyond a long")
    return scores.astype(np.int64)


def _under(scores: np.ndarray) -> np.ndarray:
    """Doubles that are no larger than the scores."""
    out = scores.astype(np.float64)
    return np.where(np.abs(out) < 2**53, out, out - np.abs(out) * 2.0**-51)


class QueryBlock:
    """A block of queries with their running bounds."""

    def __init__(self, ids: np.ndarray, rows: pa.Array, k: int) -> None:
        self.ids, self.k = ids, k
        self.width = max((len(r) // 8 for r in rows.to_pylist()), default=0)
        self.matrix = _matrix(rows, self.width)
        self.norms = np.sqrt((self.matrix**2).sum(1))
        self.bound = np.full(len(ids), -np.inf)
        self.focus = np.abs(self.matrix).argmax(1) if self.width else np.zeros(len(ids), np.int64)

    def start(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Bounds from the longest vectors."""
        for a in range(0, len(self.ids), 1024):
            which = np.arange(a, min(a + 1024, len(self.ids)))
            scores = _under(exact_products(self.matrix[which], vectors))
            scores[self.ids[which][:, None] == ids[None, :]] = -np.inf
            if scores.shape[1] >= self.k:
                self.bound[which] = np.partition(scores, -self.k, axis=1)[:, -self.k]

    def bucket(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector id, score) of all pairs that reach the bounds."""
        longest = norms.max()
        live = np.flatnonzero(self.norms * longest * (1 + 1e-12) >= bound)
        if not len(live):
            return live, ids[:0], np.zeros(0, np.int64)
        need = bound[live] / np.maximum(self.norms[live] * longest, 1e-300)
        steep = live[need > 0.3]
        if len(steep):
            pairs = self._by_coordinate(steep, vectors, norms, need[need > 0.3])
            if pairs is not None:
                flat = live[need <= 0.3]
                found = [self._verified(*pairs, ids, vectors, bound)]
                if len(flat):
                    found.append(self._whole(flat, ids, vectors, bound))
                return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        return self._whole(live, ids, vectors, bound)

    def _by_coordinate(self, which: np.ndarray, vectors: np.ndarray, norms: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs whose focus coordinate allows the cosine; None if they are not few."""
        unit = vectors / np.maximum(norms, 1e-300)[:, None]
        need = np.minimum(need, 1)
        at = self.focus[which]
        q = self.matrix[which, at] / np.maximum(self.norms[which], 1e-300)
        slack = np.sqrt((1 - need**2) * np.maximum(1 - q**2, 0)) + 1e-9
        # with the focus coordinate at an angle b from its axis and q's at a, |a - b| must be within the
        # angle of ``need``: that bounds the coordinate on the side away from q's sign
        low, high = np.where(q >= 0, q * need - slack, -np.inf), np.where(q >= 0, np.inf, q * need + slack)
        rows, columns, total = [], [], 0
        for f in np.unique(at):
            mine = np.flatnonzero(at == f)
            order = np.argsort(unit[:, f], kind="stable")
            a, b = np.searchsorted(unit[order, f], low[mine], "left"), np.searchsorted(unit[order, f], high[mine], "right")
            total += int((b - a).sum())
            if total > SPARSE * len(which) * len(vectors):
                return None
            rows.append(np.repeat(which[mine], b - a))
            columns.append(order[spread(a, b - a)])
        return np.concatenate(rows), np.concatenate(columns)

    def _verified(self, q: np.ndarray, v: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = float(np.abs(self.matrix[q]).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(self.width, 1)
        if most < 2**62:
            scores = (self.matrix[q].astype(np.int64) * vectors[v].astype(np.int64)).sum(1)
        else:
            scores = np.array([exact_products(self.matrix[[a]], vectors[[b]])[0, 0] for a, b in zip(q.tolist(), v.tolist(), strict=True)], object)
        ok = (scores >= bound[q]).astype(bool) & (self.ids[q] != ids[v])
        return q[ok], ids[v[ok]], as_longs(scores[ok])

    def _whole(self, live: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = exact_products(self.matrix[live], vectors)
        r, c = np.nonzero(scores >= bound[live][:, None])
        own = self.ids[live[r]] != ids[c]
        r, c = r[own], c[own]
        return live[r], ids[c], as_longs(scores[r, c])


def _first_k(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (ties: smaller id), and each row's rank."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(firsts, np.diff(np.append(firsts, len(q))))
    ok = rank < k
    return q[ok], v[ok], s[ok], rank[ok]


def _search(shared, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shared.value
        bound = block.bound.copy()
        q = v = s = np.zeros(0, np.int64)
        for batch in batches:
            ids, norms = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            for a in range(0, len(ids), bucket):
                part = slice(a, a + bucket)
                found = block.bucket(ids[part], _matrix(batch.column(1)[part], block.width), norms[part], bound)
                if len(found[0]):
                    q, v, s = (np.concatenate(x) for x in zip((q, v, s), found, strict=True))
                    q, v, s, rank = _first_k(q, v, s, block.k)
                    last = rank == block.k - 1
                    bound[q[last]] = np.maximum(bound[q[last]], _under(s[last]))
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, block_bytes: int = BLOCK_BYTES, probe: int = PROBE, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on a column ``id`` (a long)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = quantised(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col, scale)
    by_length = stored(every.repartitionByRange(parts, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id"), "by-length")
    asked = by_length.filter(is_query)
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("v")).alias("bytes")).first()
    blocks = max(1, -(-(size.bytes or 0) // block_bytes))
    rows = lambda df: (df.column("id").to_numpy(), df.column("v").combine_chunks())
    long_ids, long_rows = rows(by_length.orderBy(F.col("norm").desc(), "id").limit(probe).select("id", "v").toArrow())
    found: DataFrame | None = None
    for b in range(blocks):
        block = QueryBlock(*rows(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()), k)  # about block_bytes
        block.start(long_ids, _matrix(long_rows, block.width))
        shared = spark.sparkContext.broadcast(block)
        part = by_length.mapInArrow(_search(shared, bucket), "query_id long, vec_id long, score long")
        if blocks > 1:  # one block at a time in the driver and the tasks
            part = stored(part, "best")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
