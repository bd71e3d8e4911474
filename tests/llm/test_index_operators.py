"""Exact dedup, importance resampling and ranked search: brute force, edges, stores that are opened again."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cuewright.llm import block_max, queries, resample
from cuewright.llm.digest_index import DigestIndex

from . import brute
from .test_edges import BENCH, TEXTS, bench, docs, empty  # noqa: F401  (fixtures)

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
ITEMS = [(1, BENCH), (4, "single"), (5, "zeta eta theta"), (6, "own text of THE second words")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*ITEMS, (2, None), (3, ""), (None, "single"), (4, "zz later text of the same id")], "item_id long, text string")


@pytest.fixture(scope="module")
def own(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@needs_tables
def test_whole_tables(spark, own):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_importance_resampling(spark, SF).collect()) == Counter(brute.importance(own, [t for _, t in items]))
    found = {}
    for r in sorted(queries.op12_block_max_wand(spark, SF).collect(), key=lambda r: (r.item_id, r.rank)):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(found[r.item_id])
    assert found == brute.ranked(own, items)
    assert Counter(tuple(r) for r in queries.op13_exact_dedup(spark, SF).collect()) == Counter(brute.exact_groups(own))


def test_native_plan(spark, docs):  # noqa: F811
    plan = DigestIndex(spark).insert(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_dedup_edges(spark, docs, empty):  # noqa: F811
    got = DigestIndex(spark).insert(docs).select("id", "keep_id", "group_size", "kept", queries.F.lower(queries.F.hex("digest"))).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.exact_groups(TEXTS))
    kept = DigestIndex(spark).unique(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter(keep for _, keep in {(sha, keep) for _, keep, _, _, sha in brute.exact_groups(TEXTS)})
    none = DigestIndex(spark)
    assert none.insert(empty).count() == 0 and none.rows().count() == 0
    assert none.insert(docs).count() == len(TEXTS)


def test_index_is_appended_to_and_opened_again(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = DigestIndex(spark, buckets=4)
    first.insert(frame([(5, "a b"), (3, "a \t b"), (4, "c")]))
    again = DigestIndex(spark, first.root)
    assert again.buckets == 4
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in again.insert(frame([(1, "a b"), (2, " a b"), (9, "new"), (8, "new")])).collect()}
    assert got == {1: (3, 1, False), 2: (2, 1, True), 9: (8, 2, False), 8: (8, 2, True)}
    with pytest.raises(RuntimeError, match="another writer"):  # first knows nothing of the second batch
        first.insert(frame([(7, "other")]))
    assert DigestIndex(spark, first.root).rows().count() == 4
    look_up = frame([(1, "x")]).select(queries.F.sha2("text", 256).cast("binary").alias("digest")).groupBy("digest").count()
    plan = look_up.join(again.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.compact(2)
    opened = DigestIndex(spark, first.root)
    assert (opened.buckets, opened.rows().count(), len(opened.batches)) == (2, 4, 1)
    assert opened.insert(frame([(1, "c")])).first().keep_id == 4


def test_importance_edges(spark, docs, empty, bench):  # noqa: F811
    target = [BENCH, BENCH, "single", "no item", "zeta eta theta", "", None]
    got = resample.resample(docs, bench).collect()
    assert Counter(map(tuple, got)) == Counter(brute.importance(TEXTS, target))
    got = resample.resample(docs, bench, buckets=7, max_run=3, percent=50, min_words=1, seed=5).collect()
    want = brute.importance(TEXTS, target, 7, 50, 1, 5, 3)
    assert Counter(tuple(r)[:4] for r in got) == Counter(x[:4] for x in want)
    assert sorted(r.rank for r in got if r.rank) == sorted(x[4] for x in want if x[4])
    assert resample.resample(empty, bench).count() == 0
    none = resample.resample(docs, bench.limit(0)).collect()
    assert Counter(map(tuple, none)) == Counter(brute.importance(TEXTS, []))


def test_crc32_of_long_and_short_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3000, 300)
    ends = starts + rng.integers(0, 90, 300)
    assert resample.crc32_ranges(data, starts, ends).tolist() == [brute.zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def by_item(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
    return out


def test_ranked_search_edges(spark, docs, empty, items):  # noqa: F811
    want = {i: x for i, x in brute.ranked(TEXTS, ITEMS).items() if x}
    shards = block_max.index(docs)
    assert by_item(block_max.search(shards, items).collect()) == want
    assert by_item(block_max.search(shards, items, block_terms=1).collect()) == want  # an item a block
    assert by_item(block_max.search(shards, items, k=1).collect()) == {i: x[:1] for i, x in want.items()}
    assert block_max.search(block_max.index(empty), items).count() == 0
    assert block_max.search(shards, items.limit(0)).count() == 0
    assert by_item(block_max.search(block_max.index(docs.filter("text is null")), items).collect()) == {}


def test_blocks_are_skipped_and_results_stay(spark):
    """Over many blocks with ties: equal to brute force, with most blocks of a common term left packed."""
    rng = random.Random(2)
    texts = []
    for k in range(6000):
        words = [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(5, 60))]
        if k % 997 == 0:
            words += ["rare"] * 5
        texts.append((k, " ".join(words)))
    queries_ = [(1, "aaa rare"), (2, "aaa bbb"), (3, "rare"), (4, "hhh zzz none")]
    made = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    shards = block_max.index(made)
    got = block_max.search(shards, spark.createDataFrame(queries_, "item_id long, text string")).collect()
    assert by_item(got) == brute.ranked(texts, queries_)
    own = [t for _, t in texts]
    shard, df = block_max.Shard.of(pa.array(own), 6000, sum(len(t.split()) for t in own), 8, 90)
    read, plain = [], shard.postings
    shard.postings = lambda which: read.append(len(which)) or plain(which)
    block = block_max.Items.of(queries_[:1])
    at = block_max._in_shard(shard.vocabulary, block.vocabulary)
    weights = np.array([block_max.weight(6000, int(df[a])) for a in at])
    none = np.zeros(0, np.int64)
    score, ids = shard.search(np.arange(6000), at, weights, (none, none), 3)
    assert list(zip(ids.tolist(), score.tolist(), strict=True)) == brute.ranked(texts, queries_[:1], 3)[1]
    assert sum(read) < 0.4 * sum(shard.blocks[a + 1] - shard.blocks[a] for a in at)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 129, 50)
    values = np.concatenate([rng.integers(0, 1 << rng.integers(1, 30), n) if n % 5 else np.zeros(n, np.int64) for n in sizes.tolist()])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    packed = block_max.Packed.of(values, firsts, sizes)
    which = np.array([3, 49, 0, 17])
    want = np.concatenate([values[firsts[k] : firsts[k] + sizes[k]] for k in which])
    assert packed.get(which, sizes[which]).tolist() == want.tolist()
    assert block_max.length_rates(np.array([2**40, 3]), 2**30, 2**20, 90).tolist() == [10 + 90 * 2**50, 10 + (90 * 3 * 2**30) // 2**20]
