"""SimHash near-dedup with pivot distance tables.

Documents become 64-bit fingerprints (a bit is set if over half of the shingle hashes set it), and
documents of one fingerprint become one class before anything is compared.  A class has a row of the
pivot table: its Hamming distances to fixed reference fingerprints, computed once and kept with it.
Two fingerprints whose distances to any pivot differ by more than ``bits`` cannot link (triangle
inequality), so a pair is discarded by its maximum coordinate difference, and only survivors have
their bits compared.

Distances of unlike texts to a pivot gather around 32, so one coordinate discards only about half of
all pairs, and no order of the table brings the links together.  Pairs are therefore taken from
groups that agree on one of ``bits`` + 1 segments of the fingerprint: a link differs in at most
``bits`` of them, so no link is lost.  Inside a group the pivot table decides alone which pairs are
compared: pairs come sorted by the first coordinate, and each further one halves them again.  A key
that more than ``group_limit`` classes share is cut again by the segments of its other bits, and so
on, so that no task gets an unbounded group, and of the links of a group only as many are put out as
connect it.

Defined results: a text without words has fingerprint zero, and links like any other; a null id
takes part and gets the smallest non-null id it reaches (null if none); repeated rows and ids each
get their class's component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import checkpoint, thrifty
from .text_arrays import LOWER, NOT_SPACE, mix, pieces, spread, words

BITS, SEED, SHINGLE = 3, 42, 3
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
GROUP_LIMIT = 2000
#: Rows whose groups are searched together, and pairs that are looked at together.
HELD_ROWS, HELD_PAIRS = 1 << 16, 1 << 21


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text, as uint64."""
    out = []
    for piece in pieces(column):
        starts, ends, counts = words(piece, NOT_SPACE)
        sizes = ends - starts
        # the words of all texts, each followed by one space, so that a shingle is one byte range
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        total = int(at[-1])
        source = np.zeros(total, np.int64)
        if total:
            source = np.repeat(starts - at[:-1], sizes + 1) + np.arange(total)
            source[at[1:] - 1] = 0
        line = LOWER[piece.data[source]] if total else np.zeros(0, np.uint8)
        line[at[1:] - 1] = 32
        flat = line.tobytes()
        n_shingles = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
        first_word = np.concatenate([[0], np.cumsum(counts)[:-1]])
        begin = np.repeat(first_word - np.concatenate([[0], np.cumsum(n_shingles)[:-1]]), n_shingles) + np.arange(int(n_shingles.sum()))
        finish = begin + np.repeat(np.minimum(counts, shingle), n_shingles)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[finish] - 1).tolist(), strict=True)], np.uint64)
        out.append(_majority(hashes, n_shingles))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of hashes: the bits that over half of them set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        votes[full] = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]])[full], axis=0, dtype=np.int32)
    won = (2 * votes > sizes[:, None]).astype(np.uint8)
    return np.packbits(won, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], ["id", "fp"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(thrifty(run), f"id {read.schema['id'].dataType.simpleString()}, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """A row of distances a fingerprint, as bytes."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.uint8)


def with_pivots(classes: DataFrame) -> DataFrame:
    """(fp, table): the distances of each fingerprint to the pivots, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy().view(np.uint64))
            bounds = np.arange(len(table) + 1, dtype=np.int32) * len(PIVOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(bounds), pa.py_buffer(table)])], ["fp", "table"])

    return classes.select("fp").mapInArrow(thrifty(run), "fp long, table binary")


def _masks(free: int, bits: int) -> list[int]:
    """The free bits in ``bits`` + 1 segments of nearly one size, as masks."""
    own = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(own), bits + 1) if len(x)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, frees: list[int], bits: int) -> DataFrame:
    """Each node once for each segment of its free bits: the segment's bits join the path."""
    rows = [(_signed(free), number, _signed(mask), _signed(free & ~mask)) for free in frees for number, mask in enumerate(_masks(free, bits))]
    masks = nodes.sparkSession.createDataFrame(rows, "free long, mask int, bits long, rest long")  # (bits + 1) ** level rows at most
    key = F.concat_ws(".", "path", F.col("mask").cast("string"), F.hex(F.col("fp").bitwiseAND(F.col("bits"))))
    return nodes.join(F.broadcast(masks), "free").select(key.alias("path"), F.col("rest").alias("free"), "fp", "table")


def _near(group: np.ndarray, fps: np.ndarray, table: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of one group that link: pivot table first, then the bits."""
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order].astype(np.int64), fps[order], table[order].astype(np.int16)
    key = group * 512 + table[:, 0]
    sizes = np.searchsorted(key, key + bits, "right") - np.arange(len(key)) - 1
    before = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(before, before[a] + HELD_PAIRS, "right")) - 1)
        i = np.repeat(np.arange(a, b), sizes[a:b])
        j = spread(np.arange(a, b) + 1, sizes[a:b])
        for c in range(1, table.shape[1]):
            close = np.abs(table[i, c] - table[j, c]) <= bits
            i, j = i[close], j[close]
        link = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        yield order[i[link]], order[j[link]]
        a = b


def _forest(group: np.ndarray, fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links within the groups: each row with the first row of its component."""
    label = np.arange(len(fps))
    for i, j in _near(group, fps, table, bits):
        while True:  # the lesser label of two linked rows, until nothing moves
            least = np.minimum(label[i], label[j])
            if (label[i] == least).all() and (label[j] == least).all():
                break
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def _links_of_groups(bits: int):
    """Over rows (path, fp, table) sorted by path: the links of each run of equal paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def searched(close: bool) -> pa.RecordBatch:
            """The links of the whole groups held; the last one may go on unless ``close``."""
            paths, fps, table = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.concatenate([[True], paths[1:] != paths[:-1]]) if len(paths) else np.zeros(0, bool)
            done = len(paths) if close or not len(paths) else int(np.flatnonzero(new)[-1])
            held[:] = [(paths[done:], fps[done:], table[done:])]
            found = _forest(np.cumsum(new[:done]), fps[:done], table[:done], bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

        size = 0
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy().view(np.uint64), table))
            size += len(table)
            if size >= HELD_ROWS:
                yield searched(False)
                size = len(held[0][0])
        if held:
            yield searched(True)

    return run


def links(classes: DataFrame, bits: int = BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) fingerprints at ``bits`` or fewer differing bits, enough to connect all that link.

    ``classes``: distinct ``fp``.
    """
    nodes, frees = with_pivots(classes).select(F.lit("").alias("path"), F.lit(-1).cast("long").alias("free"), "fp", "table"), [(1 << 64) - 1]
    found: list[DataFrame] = []
    while frees:  # each level leaves a share bits / (bits + 1) of the free bits
        keyed = _keyed(nodes, frees, bits)
        sizes = keyed.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        shared = checkpoint(keyed.join(sizes, "path").select("path", "free", "fp", "table", "n"))
        too_large = F.col("n") > group_limit
        frees = [f for f in (r.free & (1 << 64) - 1 for r in shared.filter(too_large).select("free").distinct().collect()) if f.bit_count() > max(8, bits)]
        # with so few free bits left, at most 2**8 fingerprints can share a path
        again = too_large & F.col("free").isin([_signed(f) for f in frees]) if frees else F.lit(False)
        groups = shared.filter(~again).select("path", "fp", "table")
        found.append(groups.repartition("path").sortWithinPartitions("path").mapInArrow(thrifty(_links_of_groups(bits)), "a long, b long"))
        nodes = shared.filter(again).select("path", "free", "fp", "table")
    return reduce(DataFrame.unionByName, found)


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    prints = checkpoint(with_fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(links(classes, bits, group_limit)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id.

    Of rows that share that id, the one of the smallest text stays.  Rows of a null id stay only if
    their whole group has no id; then the smallest text of each fingerprint stays.
    """
    found = components(docs, id_col=id_col, text_col=text_col, bits=bits, shingle=shingle)
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = _smallest_text(docs.join(kept.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns), id_col, text_col)
    nameless = docs.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return named
    lost = found.filter(F.col("component_id").isNull()).select(F.col("fingerprint").alias(PRINT)).distinct()
    prints = with_all_columns(nameless, text_col, shingle).join(lost, PRINT, "left_semi")
    return named.unionByName(_smallest_text(prints, PRINT, text_col).drop(PRINT))


#: Name of the fingerprint beside a document's own columns.
PRINT = "_simhash_fingerprint"


def _smallest_text(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """Of the rows of each key the one of the smallest text (null and empty first)."""
    best = F.min_by(F.struct(*rows.columns), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def with_all_columns(docs: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint in hex as a last column."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([f"{x:016x}" for x in fingerprints(batch.column(position), shingle).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, PRINT])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(thrifty(run), f"{fields}, {PRINT} string")
