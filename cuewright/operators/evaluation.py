"""Recognition quality against a reference: edit distances, error rates, roll-ups and gates."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import collapsed_upper, evaluation_text, stripped_upper, word_tokens

#: The gain a fallback needs in each mode (pure: never), and the strict gate.
MODES = [("pure", None), ("hybrid", 0.08), ("strict", 0.12)]
STRICT_CER, STRICT_WER = 0.02, 0.08


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Unit-cost edits between two sequences: a column of the table at a time, as the bits of two integers
    that say where it rises and where it falls (Myers, 1999)."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places: dict[Hashable, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, distance = every, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        stays = same | falls
        crosses = ((same & rises) + rises ^ rises) | same
        up, down = falls | every & ~(crosses | rises), rises & crosses
        distance += 1 if up & last else -1 if down & last else 0
        up = (up << 1 | 1) & every
        rises, falls = (down << 1) & every | every & ~(stays | up), up & stays
    return distance


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two arrays of tokens; null if either is."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def text_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between the characters of two texts of any length; null if either is."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def error_rate(expected: Column, actual: Column) -> Column:
    """Edits by expected tokens (over 1 if the other is longer); 0 or 1 if nothing is expected."""
    empty = F.when(F.size(actual) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(expected) == 0, empty).otherwise(edit_distance(expected, actual) / F.size(expected))


def char_error_rate(expected: Column, actual: Column) -> Column:
    """The same over characters, with the built-in distance."""
    empty = F.when(F.length(actual) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(expected) == 0, empty).otherwise(F.levenshtein(expected, actual) / F.length(expected))


def training_error_rate(truth: Column, decoded: Column) -> Column:
    return F.levenshtein(truth, decoded) / F.greatest(F.length(truth), F.lit(1))


def line_similarity(a: Column, b: Column) -> Column:
    """1 - edits by the longer's tokens, not below 0."""
    longest = F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.greatest(F.lit(0.0), 1 - edit_distance(a, b) / longest)


def fixture_similarity(cer: Column, wer: Column) -> Column:
    """The better of both rates, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(1 - cer, 1 - wer)))


def score_fixtures(fixtures: DataFrame) -> DataFrame:
    """Adds wer, cer, similarity and meets_threshold to fixtures (expected_text, actual_text, min_similarity)."""
    words = lambda c: F.filter(F.split(collapsed_upper(F.col(c)), " "), lambda w: w != "")
    scored = fixtures.withColumn("wer", error_rate(words("expected_text"), words("actual_text"))).withColumn("cer", char_error_rate(stripped_upper(F.col("expected_text")), stripped_upper(F.col("actual_text"))))
    return scored.withColumn("similarity", fixture_similarity(F.col("cer"), F.col("wer"))).withColumn("meets_threshold", F.col("similarity") >= F.col("min_similarity"))


def summarise_modes(results: DataFrame) -> DataFrame:
    """A row a mode and a row a mode and language (grouping sets); averages of nothing are 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    made = results.groupingSets([["mode"], ["mode", "language"]], "mode", "language").agg(
        F.count("*").alias("fixture_count"), mean("cer").alias("avg_cer"), mean("wer").alias("avg_wer"), mean("similarity").alias("avg_similarity"),
        mean(F.col("meets_threshold").cast("double")).alias("pass_rate"), mean("infer_ms").alias("avg_infer_ms"), F.count_if("used_fallback").alias("replacements"), F.grouping("language").cast("int").alias("whole_mode"),
    )
    return made


def with_modes(results: DataFrame) -> DataFrame:
    """Each result once a mode, with the gain the mode asks for (three rows of literals, no shuffle)."""
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(g).cast("double").alias("min_gain")) for m, g in MODES))
    return results.withColumn("_m", F.explode(modes)).select("*", "_m.mode", "_m.min_gain").drop("_m")


def replaces(confidence: Column, candidate: Column, processed: Column, min_gain: Column, repaired: Column, spacing: Column) -> Column:
    """Whether the fallback's text is taken: low confidence, enough gain, and not for spacing alone."""
    return F.coalesce(min_gain.isNotNull() & (confidence < 0.30) & (candidate >= processed + min_gain) & ~repaired & ~spacing, F.lit(False))


def with_pair_similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity to aligned pairs (ref_text, hyp_text); a cue without a partner counts as empty text."""
    tokens = lambda c: word_tokens(evaluation_text(F.coalesce(F.col(c), F.lit(""))))
    return pairs.withColumn("similarity", F.when(F.col("ref_ord").isNull(), 0.0).otherwise(line_similarity(tokens("ref_text"), tokens("hyp_text"))))


def worst(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The k least similar pairs, in cue order among equals: a top-k, no full sort."""
    return pairs.orderBy("similarity", F.col("ref_ord").asc_nulls_last(), "hyp_ord").limit(k)


def roll_up(pairs: DataFrame, *, track: str = "track_id") -> DataFrame:
    """Error rates of each track: one distance over all its aligned cues joined by spaces, in cue order.

    Cues of the hypothesis without a partner come last.  A track is one file's subtitles, so its text is
    one value; the distance takes a few big integers of as many bits, not a table.
    """
    text = lambda c: evaluation_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ref_ord").isNull().alias("_extra"), "ref_ord", "hyp_ord", F.coalesce(c, F.lit("")).alias("_text")))), lambda s: s["_text"]), " "))
    joined = pairs.groupBy(track).agg(text("ref_text").alias("_ref"), text("hyp_text").alias("_hyp"))
    own = joined.select(track, "_ref", "_hyp", word_tokens(F.col("_ref")).alias("_ref_words"), word_tokens(F.col("_hyp")).alias("_hyp_words"))
    counted = own.select(
        track, F.size("_ref_words").cast("long").alias("reference_words"), F.size("_hyp_words").cast("long").alias("hypothesis_words"), F.length("_ref").cast("long").alias("reference_chars"), F.length("_hyp").cast("long").alias("hypothesis_chars"),
        edit_distance("_ref_words", "_hyp_words").cast("long").alias("word_edits"), text_distance("_ref", "_hyp").cast("long").alias("char_edits"),
    )
    rate = lambda edits_, n, other: F.when(F.col(n) > 0, F.col(edits_) / F.col(n)).when(F.col(other) > 0, 1.0).otherwise(0.0)
    rated = counted.withColumn("wer", rate("word_edits", "reference_words", "hypothesis_words")).withColumn("cer", rate("char_edits", "reference_chars", "hypothesis_chars"))
    similarity = lambda c: 1 - F.least(F.col(c), F.lit(1.0))
    return rated.withColumn("word_similarity", similarity("wer")).withColumn("char_similarity", similarity("cer")).withColumn("accepted", accepted(F.col("cer"), F.col("wer")))


def accepted(cer: Column, wer: Column, max_cer: float = STRICT_CER, max_wer: float = STRICT_WER) -> Column:
    return (cer <= max_cer) & (wer <= max_wer)


def epoch_means(batches: DataFrame, *metrics: str, size: str = "n", group: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Means of batch metrics weighted by batch size."""
    return batches.groupBy(*group).agg(*((F.sum(F.col(m) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))).alias(m) for m in metrics))
