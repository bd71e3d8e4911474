"""Every stage of the pipeline against brute force, each on what the one before kept."""

import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import language_id, merge_dropout
from cuewright.llm.queries import TOKENIZER

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_stages_against_brute_force(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, docs: stages[name](spark, docs, SF)
    read = lambda name, df: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    kept = read("language", step("language", docs))
    want = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)
    trained = language_id.train(docs)
    judged = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, trained).collect() if r.lang_pred != "und"}
    assert {(r.doc_id, r.lang) for r in kept.collect()} == judged

    cut = read("lines", step("lines", kept))
    digests = brute.line_dedup(want)
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows} == {d: x[2] for d, x in digests.items()}
    assert cut.filter("n_chars <> length(text)").count() == 0

    single = read("near_duplicates", step("near_duplicates", cut))
    groups = brute.simhash_components({d: brute.fingerprint(t) for d, t in rows})
    assert {r.doc_id for r in single.collect()} == {d for d, least in groups.items() if d == least}
    texts = dict(rows)
    rows = [(d, texts[d]) for d, least in groups.items() if d == least]

    clean = read("benchmark", step("benchmark", single))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, x in brute.contamination(rows, items).items() if x[4]}
    assert bad and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - bad

    model = merge_dropout.PieceModel(TOKENIZER)
    encoded = step("pieces", clean)
    back = {r.doc_id: r.text for r in merge_dropout.decode(encoded, model).collect()}
    assert back == {d: t for d, t in rows if d not in bad}
    assert encoded.filter("not lossless or n_pieces <> size(ids)").count() == 0

    whole = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).select("doc_id").collect():
        whole[r.doc_id] += 1
    assert dict(whole) == dict.fromkeys(back, 1)


def test_the_language_stage_goes_by_the_text(spark):
    """Wrong and missing labels are replaced by what a plain parse with every language says; only und goes."""
    from .test_models_small import plain_languages

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).filter("doc_id < 40")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(F.col("doc_id") % 10 == 9, F.lit("12 ... 3")).otherwise(F.substring("text", 1, 400)))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, wrong, SF).collect()}
    trained = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = {r.doc_id: r.text for r in wrong.collect()}
    want = dict(zip(texts, plain_languages(trained.texts, list(texts.values())), strict=True))
    assert got == {d: lang for d, (lang, _) in want.items() if lang != "und"}
    assert len(got) < 40
