"""Importance resampling towards a target corpus, over inverted postings that are dealt by bucket.

Texts become runs of one to ``max_run`` words, hashed into ``buckets`` buckets.  A task writes, for a
slice of texts, one block a bucket: which of the slice's texts hold it and how often.  Blocks are
shuffled by bucket and meet there the two corpora's counts of it, from which the bucket's gain

    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))

is made on the spot (s, t: the bucket's features in the source and in the target; S, T: all).  What a
bucket adds to each text goes back, summed, to the slice, where a text's weight is the floored mean
over its features.  Gumbel noise keyed by ``seed`` and id makes the highest scores a sample without
replacement in proportion to exp(weight / 1000).

At size: a posting takes three bytes in a block, twice over the network.  A bucket that every text
holds has one block a slice and one row of gains, so adaptive execution can split its join; gains are
at most ``buckets`` rows.  Texts are ranked by a range-partitioned sort that is written once; ranks are
the place in a partition plus the sizes of those before it.

Defined results: null and empty texts have no features and the weight 0; an empty target or source
counts 0; a null id is noised as an empty one and sorts last among equal scores; rows that repeat an
id are each judged, with the same noise; equal rows may take either rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text_arrays import ALNUM, LOWER, pieces, spread, words

#: Bytes of the texts whose postings are written together, and texts at most (their numbers take two bytes).
SLICE_BYTES = 8 << 20
SLICE_ROWS = 1 << 16
#: Bytes that are cut into words at once.
PIECE_BYTES = 1 << 20


def _crc_table() -> np.ndarray:
    """The bytewise table of the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 48) -> np.ndarray:
    """crc32 of each byte range; ranges of one length are stepped through together, long ones alone."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for size in np.unique(sizes[sizes <= long]).tolist():
        which = np.flatnonzero(sizes == size)
        crc, at = np.full(len(which), 0xFFFFFFFF, np.uint32), starts[which]
        for k in range(size):
            crc = _CRC[(crc ^ data[at + k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[which] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > long).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def features(column: pa.Array, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole texts, some at a time: each feature's text number and crc32, and all texts' words."""
    for piece in pieces(column, PIECE_BYTES):
        starts, ends, n_words = words(piece, ALNUM)
        sizes = ends - starts
        row = np.repeat(np.arange(len(n_words)), n_words)
        # the words one after the other, lower-cased, a space after each
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = np.full(int(begins[-1]), 0x20, np.uint8)
        joined[spread(begins[:-1], sizes)] = LOWER[piece.data[spread(starts, sizes)]]
        rows, codes = [], []
        for run in range(1, max_run + 1):
            first = np.flatnonzero(row[: len(row) - run + 1] == row[run - 1 :]) if len(row) >= run else np.zeros(0, np.int64)
            rows.append(row[first] + piece.first)
            codes.append(crc32_ranges(joined, begins[first], begins[first + run] - 1))
        yield np.concatenate(rows), np.concatenate(codes), n_words


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each; ``_wide`` tells the width from how many there are."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if most <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // n]).astype(np.int64)


BLOCK = "slice long, bucket int, n_total long, n int, rows binary, counts binary"


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(column), SLICE_BYTES):
            for first in range(piece.first, piece.last, SLICE_ROWS):
                yield batch.slice(first, min(SLICE_ROWS, piece.last - first))


def postings(docs: DataFrame, *, id_col: str, text_col: str, buckets: int, max_run: int) -> DataFrame:
    """Blocks (slice, bucket, n_total, n, rows, counts), and one row a slice of bucket -1 with its texts: ids, n_features, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in _slices(batches, 1):
            n = len(batch)
            keys, totals, n_features, all_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, np.int64), []
            for row, code, n_words in features(batch.column(1), max_run):
                found, counts = np.unique((code % np.uint32(buckets)).astype(np.int64) * n + row, return_counts=True)
                keys.append(found)
                totals.append(counts)
                n_features += np.bincount(row, minlength=n)
                all_words.append(n_words)
            key, count = np.concatenate(keys), np.concatenate(totals)
            order = np.argsort(key, kind="stable")  # a text is whole in one of the pieces, so no key repeats
            key, count = key[order], count[order]
            bucket, row = np.divmod(key, n)
            firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
            lasts = np.append(firsts[1:], len(bucket))
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            own = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(x)) for x in (n_features, np.concatenate(all_words))]
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([-1], pa.int32()), pa.array([int(n_features.sum())]), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), ids, *own], names)
            sums = np.add.reduceat(count, firsts) if len(firsts) else firsts
            rows = [_narrow(row[a:b]) for a, b in zip(firsts, lasts, strict=True)]
            counts = [_narrow(count[a:b]) for a, b in zip(firsts, lasts, strict=True)]
            m = len(firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(place), m), pa.array(bucket[firsts], pa.int32()), pa.array(sums, pa.int64()), pa.array(lasts - firsts, pa.int32()), pa.array(rows, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(m, ids.type), pa.nulls(m, own[0].type), pa.nulls(m, own[1].type)],
                names,
            )
            place += 1

    names = [x.split()[0] for x in BLOCK.split(", ")] + ["ids", "n_features", "n_words"]
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"{BLOCK}, ids array<{kind}>, n_features array<long>, n_words array<long>")


def bucket_counts(texts: DataFrame, *, text_col: str, buckets: int, max_run: int) -> DataFrame:
    """(bucket, n): features a bucket, of buckets that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, code, _ in features(batch.column(0), max_run):
                held += np.bincount(code % np.uint32(buckets), minlength=buckets)
        which = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(held[which])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket of the source, from (bucket, n) of both corpora: at most ``buckets`` rows."""
    totals = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).first().n for x in (source, target)]
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(totals[0] + buckets) / ((s + 1) * F.lit(totals[1] + buckets))
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    return both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their gains, those of a slice together -> (slice, sums): what they add to each of its texts."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["slice", "sums"])

    now, sums = None, np.zeros(0, np.int64)
    for batch in batches:
        for at, n, rows, counts, gain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != now:
                if now is not None:
                    yield made()
                now, sums = at, np.zeros(0, np.int64)
            row = _wide(rows, n)
            if row[-1] >= len(sums):
                sums = np.concatenate([sums, np.zeros(int(row[-1]) + 1 - len(sums), np.int64)])
            sums[row] += _wide(counts, n) * gain
    if now is not None:
        yield made()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, sums, ids, n_features, n_words), each slice's own row before its sums -> a row a text."""

    def made() -> pa.RecordBatch:
        ids, n_features, n_words = own
        weight = np.floor_divide(sums, np.maximum(n_features, 1))
        return pa.RecordBatch.from_arrays([ids, pa.array(n_features), pa.array(n_words), pa.array(weight)], ["id", "n_features", "n_words", "weight"])

    own, sums = None, np.zeros(0, np.int64)
    for batch in batches:
        for k in range(len(batch)):
            if batch.column(1)[k].is_valid:
                part = np.frombuffer(batch.column(1)[k].as_buffer(), "<i8")
                sums[: len(part)] += part
                continue
            if own is not None:
                yield made()
            own = [batch.column(2)[k].values, *(batch.column(c)[k].values.to_numpy() for c in (3, 4))]
            sums = np.zeros(len(own[0]), np.int64)
    if own is not None:
        yield made()


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, max_run: int = 1) -> DataFrame:
    """(id, n_features, n_words, weight) of every text of ``docs``."""
    blocks = stored(postings(docs, id_col=id_col, text_col=text_col, buckets=buckets, max_run=max_run), "postings")
    held = blocks.filter("bucket >= 0")
    source = held.groupBy("bucket").agg(F.sum("n_total").alias("n"))
    # written, so that both sides of the next join are shuffled and a hot bucket's blocks can be split
    gain = stored(gains(source, bucket_counts(target, text_col=target_text_col, buckets=buckets, max_run=max_run), buckets), "gains")
    met = held.join(gain.hint("merge"), "bucket").select("slice", "n", "rows", "counts", "gain").sortWithinPartitions("slice")
    parts = met.mapInArrow(_contributions, "slice long, sums binary")
    slices = blocks.filter("bucket < 0").select("slice", F.lit(None).cast("binary").alias("sums"), "ids", "n_features", "n_words")
    both = slices.unionByName(parts, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.col("sums").isNotNull())
    return both.mapInArrow(_texts, f"id {blocks.schema['ids'].dataType.elementType.simpleString()}, n_features long, n_words long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from the first eight hex digits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, n_features, weight, score, rank) of every text; rank counts the drawn ones from 1, others have none.

    Of the N texts of ``min_words`` words or more, floor(percent * N / 100) of the highest scores are drawn.
    """
    weighed = weigh(docs, target, id_col=id_col, **how)
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise(seed, F.col("id"))).alias("score"), (F.col("n_words") >= min_words).alias("able"))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    placed = stored(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "resampled")  # part << 33 | place in it
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("n_able")).orderBy("part").collect()  # a row a partition
    before, starts = 0, []
    for row in sizes:
        starts.append((row.part, before))
        before += row.n
    drawn = percent * sum(row.n_able for row in sizes) // 100
    offsets = docs.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank)
    return ranked.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
