"""Language-model scores from an Elias-Fano n-gram trie over the whole training corpus.

Unigrams are add-one estimates over all training tokens: (c + 1) / (N + V + 1), the rest for any
unseen word.  Above them, a bigram (v, w) seen at least ``min_count`` times has probability
(c - D) / c(v) + L(v) * p(w), and any other word after v has L(v) * p(w), with L(v) what the
discounts leave.  Every bigram of at least ``min_count`` is kept, whatever its words' share.  Stored
probabilities are rounded down, so that they never sum to more than one.

How it scales.  Counts are shuffles with partial sums first; bigram counts travel as sorted, packed
blocks, dealt by a hash of the pair, so that no context is hot.  What is most frequent is sent to the
tasks and never shuffled with documents, which would put a third of all rows on one key:

* the ``WORDS`` most frequent words at most, by hash with their counts (16 MB).  Other training words
  are met by a shuffle of the documents' words outside that list;
* the ``ENTRIES`` most frequent bigrams of such words at most, in the trie, about 5 bytes each.  It is
  built in shards of contexts, one task a shard, and sent to the tasks in blocks of at most
  ``block_bytes``, memory-mapped there; a second block is a second pass over the documents.  Other
  bigrams, and what the discounts leave of contexts outside the word list, are a table by a 64-bit
  key, to which a document's own keys are shuffled, but for those that a bit set of at most 2**29 bits
  shows to be absent.  The bit set only saves shuffles; when it is full everything is shuffled.

Both bounds only say where a count is looked up, never whether: scores are the same for any bounds.

Defined results: null is the empty text, whose one token is the end; a null id counts as training
text; rows that repeat an id are scored each, and learnt from each; without training text every
token has probability 1 / (0 + 0 + 1).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_trie import NgramTrie, uncoded
from .shared import stored
from .text_arrays import FIRST, NOT_SPACE, Piece, mix, pieces, words

#: Words whose counts, and bigrams of theirs that, are sent to the tasks: the most frequent, so many at most.
WORDS, ENTRIES = 1 << 20, 1 << 24
DISCOUNT = 0.75
SHARD_ENTRIES = 1_000_000
BLOCK_BYTES = 96 << 20
SIEVE_BITS = 29
#: Texts that are scored together, so that a bigram they repeat is looked up once.
SCORE_BYTES = 4 << 20
#: Training tokens whose bigrams are summed in one group, and bigrams that a task sums before it sends them.
GROUP_TOKENS, HELD_BIGRAMS = 2_000_000, 2_000_000
END = mix(np.array([0xE0D], np.uint64))[0]
#: Codes of words: the number of a listed word, else the hash with this bit set, hence negative.
TAIL = np.uint64(1 << 63)
#: Stands for the word where a key is of a context alone; no word has this code.
ALONE = np.int64(1 << 40)


class HashIndex:
    """Places of uint64 keys in a sorted array, by a table over their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(63 - max(0, min(22, int(len(keys)).bit_length())))
        self.start = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = (keys >> self.shift).astype(np.int64)
        at = self.start[bucket]
        todo = np.arange(len(keys))
        while len(todo):
            here = at[todo]
            inside = here < len(self.keys)
            todo, here = todo[inside], here[inside]
            held, want = self.keys[here], keys[todo]
            hit = held == want
            out[todo[hit]] = here[hit]
            more = held < want
            todo = todo[more]
            at[todo] += 1
        return out


class Sieve(NamedTuple):
    """A bit for each leading part of the uint64 keys that are held."""

    bits: np.ndarray
    size: int

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.size)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve(keys: DataFrame) -> Sieve:
    """Of the column ``h``, built in shards of about a million keys."""
    n = keys.count()
    size = min(SIEVE_BITS, max(16, (16 * n).bit_length()))
    split = min(size - 3, max(1, (n >> 20).bit_length()))

    def build(group: pa.Table) -> pa.Table:
        at = group.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - size)
        flags = np.zeros(1 << (size - split), np.uint8)
        flags[(at & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
        return pa.table({"shard": group.column("shard").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(1 << (size - 3), np.uint8)
    width = 1 << (size - split - 3)
    for r in keys.select("h", F.shiftrightunsigned("h", 64 - split).alias("shard")).groupBy("shard").applyInArrow(build, "shard long, bits binary").toLocalIterator():
        bits[r.shard * width : (r.shard + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return Sieve(bits, size)


class Vocabulary(NamedTuple):
    """Listed words by hash, with counts and numbers; N, V and texts; log10 of what the discounts leave of each context."""

    keys: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    total: int
    distinct: int
    texts: int
    left: np.ndarray

    @property
    def start(self) -> int:
        """The context of a text's first token."""
        return len(self.keys)

    @property
    def complete(self) -> bool:
        """Whether all training words are listed."""
        return len(self.keys) == self.distinct

    def by_number(self) -> np.ndarray:
        """Occurrences of the contexts: the listed words, then the texts."""
        out = np.empty(self.start + 1, np.int64)
        out[self.number] = self.counts
        out[-1] = self.texts
        return out

    def log_unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.distinct + 1.0))


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, an end after each text; the texts' bounds."""
    starts, ends, counts = words(piece, NOT_SPACE)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = FIRST.ranges(piece.data, starts, ends)
    return out, bounds


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate(counts)[order]
    firsts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[firsts], np.add.reduceat(n, firsts) if len(firsts) else n


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """(k, n) sums over all tasks of the int64 or uint64 keys that ``keys_of`` gives for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for piece in pieces(batch.column(0)):
                k, n = np.unique(keys_of(piece).view(np.int64), return_counts=True)
                keys.append(k)
                counts.append(n)
            k, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    return texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _least_count(rows: DataFrame, most: int) -> int:
    """The least power of two that the column ``n`` of at most ``most`` rows reaches."""
    sizes = {r.bits: r["count"] for r in rows.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}  # 64 at most
    bits = max(sizes, default=0) + 1
    reached = 0
    while bits > 1 and reached + sizes.get(bits - 1, 0) <= most:
        bits -= 1
        reached += sizes.get(bits, 0)
    return 1 << (bits - 1)


def count_words(training: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The whole table of word counts, and the words that are sent to the tasks."""
    table = stored(_counted(training, lambda piece: tokens(piece)[0]), "words")
    end = int(np.array([END], np.uint64).view(np.int64)[0])
    total, distinct, texts = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("k") == end, F.col("n"))), F.lit(0))).first()
    listed = table.filter(F.col("n") >= _least_count(table, WORDS)).toArrow()  # at most WORDS rows
    keys, counts = listed.column("k").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    number = np.empty(len(keys), np.int32)
    number[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
    return table, Vocabulary(keys, counts, number, total, distinct, texts, np.zeros(len(keys) + 1))


def _codes(vocabulary: Vocabulary, index: HashIndex, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: place among the listed words, code, and the code of the token before."""
    place = index.find(hashes)
    code = (hashes | TAIL).view(np.int64)
    listed = place >= 0
    code[listed] = vocabulary.number[place[listed]]
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1]
    before[bounds[:-1]] = vocabulary.start
    return place, code, before


def pair_keys(v: np.ndarray, w: np.ndarray | np.int64) -> np.ndarray:
    return mix(mix(v.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + (w if isinstance(w, np.ndarray) else np.full(len(v), w)).view(np.uint64))


def packed(*columns: np.ndarray) -> bytes:
    """int64 columns of one length, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).data, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, size: int) -> np.ndarray:
    """The columns, a row each."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=columns * size * 8, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 8, size).transpose(0, 2, 1)).view(np.int64).reshape(columns, size)


def _summed_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, first, which = np.unique(pair_keys(v, w), return_index=True, return_inverse=True)
    return v[first], w[first], np.bincount(which, n, len(first)).astype(np.int64)


def count_bigrams(training: DataFrame, table: DataFrame, vocabulary: Vocabulary, min_count: int) -> DataFrame:
    """(v, w, n): codes and counts of the bigrams that are kept.

    Tasks send blocks of sums: of listed words as differences of sorted keys, 2**8 neighbouring words
    of a context in one block, and of others (kind 1) as the codes themselves.
    """
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)
    # a bigram has no more occurrences than either of its words
    others = _tail_words(table, vocabulary, min_count)
    often = None if vocabulary.complete else training.sparkSession.sparkContext.broadcast(sieve(others.select(F.col("k").alias("h"))))
    groups = max(1, -(-vocabulary.total // GROUP_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = HashIndex(own.keys)
        keys, counts, tails, held = [], [], [], 0

        def blocks() -> pa.RecordBatch:
            k, n = _summed([np.zeros(0, np.int64), *keys], [np.zeros(0, np.int64), *counts])
            v, w, m = _summed_pairs(*(np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *tails, strict=True)))
            out: list[tuple[int, int, int, bytes]] = []
            for kind, hashed, columns in ((0, mix((k >> 8).view(np.uint64)), (k, n)), (1, pair_keys(v, w), (v, w, m))):
                group = (hashed % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(groups + 1))
                for g in np.flatnonzero(np.diff(cuts)).tolist():
                    part = [c[order[cuts[g] : cuts[g + 1]]] for c in columns]
                    if kind == 0:
                        part[0] = np.diff(part[0], prepend=0)
                    out.append((g, kind, len(part[0]), packed(*part)))
            keys.clear(), counts.clear(), tails.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["g", "kind", "size", "data"])

        for batch in batches:
            for piece in pieces(batch.column(0)):
                hashes, bounds = tokens(piece)
                place, code, before = _codes(own, index, hashes, bounds)
                may = (place >= 0) & (own.counts[place] >= min_count) if len(own.counts) else np.zeros(len(place), bool)
                if often is not None:
                    may[place < 0] = often.value.maybe(hashes[place < 0])
                both = may.copy()
                both[1:] &= may[:-1]
                both[bounds[:-1]] = may[bounds[:-1]]
                listed = both & (before >= 0) & (code >= 0)
                k, n = np.unique(before[listed] << 32 | code[listed], return_counts=True)
                keys.append(k)
                counts.append(n)
                both &= ~listed
                tails.append(_summed_pairs(before[both], code[both], np.ones(int(both.sum()), np.int64)))
                held += len(k) + len(tails[-1][0])
                if held > HELD_BIGRAMS:
                    yield blocks()
                    held = 0
        yield blocks()

    def total(group: pa.Table) -> pa.Table:
        keys, counts, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 3]
        for kind, size, data in zip(*(group.column(c).to_pylist() for c in ("kind", "size", "data")), strict=True):
            columns = unpacked(data, 2 + kind, size)
            if kind == 0:
                keys.append(np.cumsum(columns[0]))
                counts.append(columns[1])
            else:
                tails.append(tuple(columns))
        k, n = _summed(keys, counts)
        v, w, m = _summed_pairs(*(np.concatenate(x) for x in zip(*tails, strict=True)))
        v, w, n = np.concatenate([k >> 32, v]), np.concatenate([k & 0xFFFFFFFF, w]), np.concatenate([n, m])
        kept = n >= min_count
        return pa.table({"v": v[kept], "w": w[kept], "n": n[kept]})

    made = stored(training.mapInArrow(run, "g int, kind int, size long, data binary").groupBy("g").applyInArrow(total, "v long, w long, n long"), "bigrams")
    for sent in (shared, often):  # the written table needs them no more
        if sent is not None:
            sent.destroy()
    return made


def _tail_words(table: DataFrame, vocabulary: Vocabulary, min_count: int) -> DataFrame:
    """(k, code, n) of words outside the list that a kept bigram can have."""
    least = int(vocabulary.counts.min(initial=1 << 62))  # all words of at least this count are listed
    rows = table.filter((F.col("n") < least) & (F.col("n") >= min_count))
    return rows.select("k", F.col("k").bitwiseOR(F.lit(-(1 << 63))).alias("code"), "n")


def with_left(bigrams: DataFrame, vocabulary: Vocabulary) -> Vocabulary:
    """The vocabulary with what all kept bigrams leave of its contexts."""
    spent = bigrams.filter("v >= 0").groupBy("v").agg(F.sum(F.col("n") - DISCOUNT).alias("spent")).toArrow()  # at most WORDS + 1 rows
    left = np.ones(vocabulary.start + 1)
    v = spent.column("v").to_numpy()
    left[v] = np.clip(1 - spent.column("spent").to_numpy() / vocabulary.by_number()[v], 1e-12, 1)
    return vocabulary._replace(left=np.log10(left))


def tail_values(bigrams: DataFrame, table: DataFrame, vocabulary: Vocabulary, min_count: int, least: int) -> DataFrame:
    """(h, value): what bigrams outside the trie, and contexts outside the list, add to log10."""
    own = _tail_words(table, vocabulary, min_count)
    spent = bigrams.filter("v < 0").groupBy("v").agg(F.sum(F.col("n") - DISCOUNT).alias("spent"))
    left = F.greatest(1 - F.col("spent") / F.col("c"), F.lit(1e-12))
    contexts = stored(spent.join(own.select(F.col("code").alias("v"), F.col("n").alias("c")), "v").select("v", F.col("c").cast("double").alias("c"), left.alias("left")), "contexts")
    shared = bigrams.sparkSession.sparkContext.broadcast(vocabulary)

    def joined(rows: DataFrame, code: str, other: DataFrame) -> DataFrame:
        """Of codes outside the list what ``other`` has, of others nulls."""
        inside = rows.filter(F.col(code) >= 0).select("*", *(F.lit(None).cast("double").alias(c) for c in other.columns if c != code))
        return inside.unionByName(rows.filter(F.col(code) < 0).join(other, code))

    pairs = joined(bigrams.filter((F.col("v") < 0) | (F.col("w") < 0) | (F.col("n") < least)), "v", contexts)
    pairs = joined(pairs, "w", own.select(F.col("code").alias("w"), F.col("n").cast("double").alias("cw")))
    alone = contexts.select("v", F.lit(int(ALONE)).alias("w"), F.lit(None).cast("long").alias("n"), "c", "left", F.lit(None).cast("double").alias("cw"))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch.column(c).to_numpy() for c in (0, 1))
            n, c, left, cw = (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False).copy() for k in (2, 3, 4, 5))
            voc: Vocabulary = shared.value
            times = voc.by_number()
            c[v >= 0], left[v >= 0] = times[v[v >= 0]], 10 ** voc.left[v[v >= 0]]
            pair = w != ALONE
            mine = pair & (w >= 0)
            cw[mine] = times[w[mine]]
            unigram = (cw + 1.0) / (voc.total + voc.distinct + 1.0)
            value = np.log10(left)
            value[pair] = np.log10(1 + (n - DISCOUNT) / (c * left * unigram))[pair]
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(v, w).view(np.int64)), pa.array(value)], ["h", "value"])

    rows = pairs.select("v", "w", "n", "c", "left", "cw").unionByName(alone)
    made = stored(rows.mapInArrow(valued, "h long, value double"), "values")
    shared.destroy()
    return made


def build_tries(bigrams: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, int, int]:
    """(shard, trie): a trie a shard of contexts; the least count of their entries; how many bigrams are in none."""
    listed = (F.col("v") >= 0) & (F.col("w") >= 0)
    least = _least_count(bigrams.filter(listed), ENTRIES)
    every = bigrams.count()
    bigrams = bigrams.filter(listed & (F.col("n") >= least))
    entries = bigrams.count()
    shards = max(1, -(-entries // SHARD_ENTRIES))
    shared = bigrams.sparkSession.sparkContext.broadcast(vocabulary)

    def build(group: pa.Table) -> pa.Table:
        own: Vocabulary = shared.value
        context, word, n = (group.column(c).to_numpy() for c in ("v", "w", "n"))
        order = np.lexsort((word, context))
        context, word, n = context[order], word[order], n[order]
        times = own.by_number()
        unigram = 10 ** own.log_unigram(times)
        share = (n - DISCOUNT) / times[context]
        probability = share + 10 ** own.left[context] * unigram[word]
        trie = NgramTrie.of(context, word, np.log10(probability))
        return pa.table({"shard": group.column("shard").slice(0, 1), "trie": pa.array([trie.to_bytes()], pa.binary())})

    sharded = bigrams.select("v", "w", "n", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    made = stored(sharded.groupBy("shard").applyInArrow(build, "shard int, trie binary"), "tries")
    shared.destroy()
    return made, least, every - entries


def _score_piece(piece: Piece, own: Vocabulary, index: HashIndex, unigram: np.ndarray, tries: list[NgramTrie], first: bool) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known listed tokens, base and score; words outside the list count as unseen if the list is complete, else not at all."""
    hashes, bounds = tokens(piece)
    place, code, before = _codes(own, index, hashes, bounds)
    listed = place >= 0
    single = np.full(len(hashes), own.log_unigram(np.zeros(1))[0] if own.complete else 0.0)
    single[listed] = unigram[code[listed]]
    gain = np.zeros(len(hashes))  # over the unigram, of tokens after these tries' contexts
    if first:
        gain[before >= 0] = own.left[before[before >= 0]]
    asked = np.flatnonzero((before >= 0) & (code >= 0))
    keys, back = np.unique(before[asked] << 32 | code[asked], return_inverse=True)
    context, word = keys >> 32, keys & 0xFFFFFFFF
    found = np.zeros(len(keys))
    for trie in tries:
        at = trie.query(context, word)
        hit = np.flatnonzero(at >= 0)
        found[hit] = uncoded(trie.codes[at[hit]]) - unigram[word[hit]] - own.left[context[hit]]
    gain[asked] += found[back]
    add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else x[:0]
    return np.diff(bounds), add(listed.astype(np.int64)), add(single), add(gain)


def _score_pass(docs: DataFrame, vocabulary, block, first: bool) -> DataFrame:
    """key, id, n_tokens, n_known, base and gain of every row; of a later block only key and gain count."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tries = vocabulary.value, [NgramTrie.mapped(x.value) for x in block]
        index, unigram = HashIndex(own.keys), own.log_unigram(own.by_number())
        for batch in batches:
            parts = [_score_piece(p, own, index, unigram, tries, first) for p in pieces(batch.column(0), SCORE_BYTES)]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(c) for c in columns)], ["key", "id", "n_tokens", "n_known", "base", "gain"])

    return docs.select("text", "key", "id").mapInArrow(run, f"key long, id {kind}, n_tokens long, n_known long, base double, gain double")


def _counted_of_texts(docs: DataFrame, keys_of) -> DataFrame:
    """(h, key, n): the distinct keys of each text, which ``keys_of`` gives a slice as (hash, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                h, row = keys_of(piece)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(1).take(pa.array(row[new] + piece.first)), pa.array(n)], ["h", "key", "n"])

    return docs.select("text", "key").mapInArrow(run, "h long, key long, n long")


def _rows(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _rare(docs: DataFrame, vocabulary) -> DataFrame:
    """The words of each text that are not listed."""

    def keys_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        hashes, bounds = tokens(piece)
        rare = HashIndex(vocabulary.value.keys).find(hashes) < 0
        return hashes[rare], _rows(bounds)[rare]

    return _counted_of_texts(docs, keys_of)


def _tail(docs: DataFrame, vocabulary, held, everything: bool) -> DataFrame:
    """The keys of each text that ``tail_values`` may hold; ``everything``: also of listed words."""

    def keys_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        own = vocabulary.value
        hashes, bounds = tokens(piece)
        _, code, before = _codes(own, HashIndex(own.keys), hashes, bounds)
        pair = np.arange(len(code)) if everything else np.flatnonzero((before < 0) | (code < 0))
        alone = np.flatnonzero(before < 0)
        h = np.concatenate([pair_keys(before[pair], code[pair]), pair_keys(before[alone], ALONE)])
        row = _rows(bounds)[np.concatenate([pair, alone])]
        may = held.value.maybe(h)
        return h[may], row[may]

    return _counted_of_texts(docs, keys_of)


def score(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn``: condition on the columns of ``docs`` for what the model is trained on.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("key"), F.coalesce(learn, F.lit(True)).alias("learn"))
    training = read.filter("learn").select("text")
    table, vocabulary = count_words(training)
    bigrams = count_bigrams(training, table, vocabulary, min_count)
    vocabulary = with_left(bigrams, vocabulary)
    tries, least, outside = build_tries(bigrams, vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)
    blocks: list[list[int]] = [[]]
    size = 0
    for shard, n in sorted(tries.select("shard", F.length("trie").alias("n")).collect()):
        if blocks[-1] and size + n > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(shard)
        size += n

    def scored(k: int) -> DataFrame:
        # a shard at a time in the driver
        block = [spark.sparkContext.broadcast(bytes(r.trie)) for r in tries.filter(F.col("shard").isin(blocks[k])).toLocalIterator()]
        return _score_pass(read, shared, block, k == 0)

    own = scored(0)
    # what other blocks, words outside the list and bigrams outside the trie add to a text
    more = [stored(scored(k).select("key", F.lit(0.0).alias("base"), "gain", F.lit(0).cast("long").alias("known")), "scores") for k in range(1, len(blocks))]
    if not vocabulary.complete:
        log = F.log10((F.coalesce("c", F.lit(0)) + 1.0) / (vocabulary.total + vocabulary.distinct + 1.0))
        counted = _rare(read, shared).join(table.select(F.col("k").alias("h"), F.col("n").alias("c")), "h", "left")
        more.append(counted.select("key", (F.col("n") * log).alias("base"), F.lit(0.0).alias("gain"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known")))
    if outside:
        values = tail_values(bigrams, table, vocabulary, min_count, least)
        held = spark.sparkContext.broadcast(sieve(values.select("h")))
        listed = bigrams.filter((F.col("v") >= 0) & (F.col("w") >= 0) & (F.col("n") < least)).limit(1).count() > 0
        more.append(_tail(read, shared, held, listed).join(values, "h").select("key", F.lit(0.0).alias("base"), (F.col("n") * F.col("value")).alias("gain"), F.lit(0).cast("long").alias("known")))
    base, gain, known = F.col("base"), F.col("gain"), F.col("n_known")
    if more:
        # rows that repeat an id and text share a key, and what they add was summed together
        parts = read.select("key", F.lit(1).alias("copies"))
        for part in more:
            parts = parts.unionByName(part, allowMissingColumns=True)
        sums = parts.groupBy("key").agg(F.sum("copies").alias("copies"), F.sum("base").alias("more_base"), F.sum("gain").alias("more_gain"), F.sum("known").alias("more_known"))
        own = own.join(sums, "key")
        share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
        base, gain, known = base + share("more_base"), gain + share("more_gain"), known + share("more_known").cast("long")
    return own.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + gain).alias("score"))
