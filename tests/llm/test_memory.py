"""What keeps an executor's memory down: small Arrow batches, and workers that give back what a task has freed."""

import ctypes
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import merge_dropout
from cuewright.llm.queries import TOKENIZER
from cuewright.llm.shared import BATCH_BYTES, small_batches

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_CONF)
    yield spark
    spark.conf.unset(BATCH_CONF)


def batch_bytes(spark):
    """The bytes of text of each batch that a Python worker gets of 3,000 texts of 10,000 letters."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, b.column(0).to_pylist()))])], ["n"])

    return [r.n for r in spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000)).mapInArrow(sizes, "n long").collect()]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_bounds_the_batches(unset, stage):
    docs = unset.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    dict(corpus_pipeline.STAGES)[stage](unset, docs, SF)
    sizes = batch_bytes(unset)
    assert sum(sizes) == 30_000_000
    assert max(sizes) <= BATCH_BYTES + 10_000


def test_a_size_that_the_session_names_is_kept(unset):
    unset.conf.set(BATCH_CONF, "100000")
    small_batches(unset)
    assert max(batch_bytes(unset)) <= 200_000


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_a_task_gives_back_what_it_freed():
    code = """
import numpy as np, pyarrow as pa
from cuewright.llm.shared import thrifty
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
pinned = []
def run(batches):
    for batch in batches:
        held = [np.ones(100_000, np.uint8) for _ in range(2_000)]  # too small to be mapped by themselves
        pinned.append(np.ones(100_000, np.uint8))  # in use after them
        yield batch
batch = pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
before = rss()
assert [b.num_rows for b in run(iter([batch]))] == [1]
kept = rss()
assert [b.num_rows for b in thrifty(run)(iter([batch]))] == [1]
print(kept - before, rss() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0]).stdout
    kept, given_back = map(int, out.split())
    assert kept > 150 and given_back < 50


def test_encoding_is_the_same_in_slices_of_any_size(spark, monkeypatch):
    rows = [(k, "Wörter und words " * (k % 40 * 100) + "😀" * (k % 3)) for k in range(120)] + [(None, "x"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = merge_dropout.PieceModel(TOKENIZER)
    every = [merge_dropout.encode_column(model, pa.array([t], pa.string()), np.array([key], np.int64).view(np.uint64), seed=1, dropout=0.1)[0].tolist() for t, key in docs.select("text", F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    got = merge_dropout.encode(docs, model).collect()
    assert [r.ids for r in got] == every
    assert all(r.lossless for r in got)
