"""Counts and normal forms of whole texts against the expressions for lines."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.functions import codepoints, recognition, text

PIECES = ["word", "a", "I", "xq", "IS", "camelCase", "it's", "''", "-x-", "é", "naïve", "x́y", "…“”‘’", "@&", "|", "1999", "12a", "averyverylongwordhere", "a'b'c'd'e'f'g'h'i'j'k'l'm'n", "日本語", "😀", "İx", "ﬁ", "٣", "Ⅷ", "-", "aa-Bb", "héLlo", "x😀y", ".x", "\x00", "\x7f", "\x1c"]
GAPS = [" ", "  ", "\n", "\r\n", "\n\n", "\t", " ", "  ", "\u0085", " ", " \n ", "\x0b", "\r", "", "　\n", "​"]
rng = random.Random(7)
TEXTS = ["", " ", "\n", "\r", "\r\n \n", "x", " x", "x\n", "@", "&", "a\n\nb", "@\r&", " @& ", None] + ["".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["", "end "]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, k % 3 > 0) for k, t in enumerate(TEXTS)], "k int, t string, spaced boolean").repartition(2).cache()


@pytest.mark.parametrize("slice_bytes", [1, 64, 1 << 20])
def test_normal_forms(rows, monkeypatch, slice_bytes):
    want = {r.k: (r.n, r.c) for r in rows.select("k", text.normalise_lines(F.col("t")).alias("n"), text.evaluation_text(F.col("t")).alias("c")).collect()}
    monkeypatch.setattr(codepoints, "SLICE", slice_bytes)
    column = pa.array(TEXTS, pa.string())
    lines = codepoints._of_texts(column, lambda p, b: codepoints.strings(*codepoints.normalised(p, b))).to_pylist()
    collapsed = codepoints._of_texts(column, codepoints.collapsed).to_pylist()
    assert {k: (a, b) for k, (a, b) in enumerate(zip(lines, collapsed, strict=True))} == want


def test_scores(rows):
    want = {r.k: (r.q, r.e) for r in rows.filter("t is not null").select("k", recognition.quality_score(F.col("t"), F.col("spaced")).alias("q"), recognition.exportable_label(F.col("t"), F.col("spaced")).alias("e")).collect()}
    made = recognition.with_quality(rows, F.col("t"), F.col("spaced"), "q", "run")
    got = {r.k: (r.q, r.e) for r in made.select("k", "q", recognition.exportable_label(F.col("t"), F.col("spaced"), F.col("q"), F.col("run")).alias("e")).collect()}
    assert got.pop(TEXTS.index(None)) == (None, None)
    assert got == want


def test_columns_in_spark(rows):
    both = rows.select("k", "t", codepoints.normalised_texts(F.col("t")).alias("n"), codepoints.collapsed_texts(F.col("t")).alias("c"))
    assert both.filter(~F.col("n").eqNullSafe(text.normalise_lines(F.col("t"))) | ~F.col("c").eqNullSafe(text.evaluation_text(F.col("t")))).count() == 0
    assert both.limit(0).count() == 0


def test_texts_become_arrow_data_a_slice_at_a_time(monkeypatch):
    """no more than a slice of strings is held at once; nulls and empty batches stay."""
    import pyarrow as pa

    from cuewright.functions import codepoints

    monkeypatch.setattr(codepoints, "SLICE", 8)
    sizes, array = [], pa.array
    monkeypatch.setattr(codepoints.pa, "array", lambda values, *a, **k: sizes.append(len(values)) or array(values, *a, **k))
    texts = array([None, " a  b ", "cdefghi", None, "", "“x”…", "long text " * 9], pa.string())
    got = codepoints._of_texts(texts, codepoints.collapsed)
    assert got.to_pylist() == [None, "a b", "cdefghi", None, "", '"x"...', ("long text " * 9).strip()]
    assert max(sizes) < len(texts)
    assert codepoints._of_texts(texts.slice(0, 0), codepoints.collapsed).to_pylist() == []
