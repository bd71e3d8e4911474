"""Queries over a whole small table against brute force."""

from pathlib import Path

import pytest

from cuewright.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_decontaminate(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert got == brute.contamination(docs, items)
    assert any(x[4] for x in got.values())


def test_line_dedup(spark, docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op7_line_dedup(spark, SF).collect()}
    assert got == brute.line_dedup(docs)
    assert any(x[1] for x in got.values())


def test_simhash(spark, docs):
    rows = queries.op10_simhash(spark, SF).collect()
    prints = {d: brute.fingerprint(t) for d, t in docs}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute.simhash_components(prints)


def test_language_id_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 20
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_merge_dropout_is_lossless(spark, docs):
    rows = queries.op4_merge_dropout(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.lossless for r in rows)
