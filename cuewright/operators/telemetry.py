"""Run telemetry: GPU samples, subtitle text metrics, counts by codec, scores in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_TOKEN = 14


def gpu_summary(samples: DataFrame, *, gpu: str = "gpu", value: str = "util") -> DataFrame:
    """n, mean, median, p95 and maximum of each GPU, rounded to two places.

    p95 is the value at place max(1, floor(0.95 n)) of the sorted samples.  Equal values are counted
    before they are gathered, so a group holds distinct readings (percentages), not samples.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(gpu, value).agg(F.count("*").alias("c"))
    values = counted.groupBy(gpu).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("max"), F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "c"))).alias("runs"))

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda s, r: F.struct((s["seen"] + r["c"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + r["c"] >= place), r["v"]).otherwise(s["v"]).alias("v"))
        return F.aggregate("runs", start, step)["v"]

    n = F.col("n")
    median = (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2
    p95 = at(F.greatest(F.floor(n * 0.95), F.lit(1)))
    return values.select(gpu, "n", F.round("mean", 2).alias("mean"), F.round(median, 2).alias("median"), F.round(p95, 2).alias("p95"), F.round(F.col("max").cast("double"), 2).alias("max"))


def text_metrics(lines: DataFrame, *group: str, text: str = "text") -> DataFrame:
    """Lines, characters, spaces, words, long tokens, longest token and space rate (null without characters)."""
    count = lambda pattern: F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(pattern))), F.lit(0))
    counted = lines.groupBy(*group).agg(
        F.count(text).alias("line_count"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("char_count"),
        F.coalesce(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))), F.lit(0)).alias("space_count"),
        count(r"\S+").alias("word_count"),
        count(rf"\S{{{LONG_TOKEN},}}").alias("long_token_count"),
        F.coalesce(F.max(F.array_max(F.transform(F.split(F.col(text), r"\s+"), F.length))), F.lit(0)).alias("max_token_len"),
    )
    return counted.withColumn("space_rate", F.try_divide("space_count", "char_count"))


def spacing_gate(metrics: DataFrame, min_space_rate: float) -> DataFrame:
    """English tracks with 120 characters or more whose space rate is too low."""
    return metrics.filter((F.col("language") == "eng") & (F.col("char_count") >= 120) & (F.col("space_rate") < min_space_rate))


def codec_counts(streams: DataFrame, bitmap: tuple[str, ...]) -> DataFrame:
    return streams.filter("kind = 'subtitle'").groupBy("codec").agg(F.count("*").alias("n")).withColumn("bitmap", F.col("codec").isin(*bitmap))


def _stated(word: str, pattern: str, kind: str) -> Column:
    """A number beside a word in log lines; lines without the word are not searched for the pattern."""
    return F.when(F.contains(F.col("line"), F.lit(word)), F.regexp_extract(F.col("line"), pattern, 1).try_cast(kind))


def _scores() -> list[Column]:
    return [F.avg(_stated(f"{n}=", rf"{n}=([0-9.]+)", "double")).alias(n) for n in ("tess_score", "ppocr_score", "ppocr_conf")]


def _counts() -> list[Column]:
    value = lambda n: _stated(n, rf"([0-9]+)\s+{n}s?\b", "long")
    return [F.max_by(value(n), F.when(value(n).isNotNull(), F.col("ord"))).alias(f"{n}s") for n in ("stream", "cue")]


def fallback_scores(lines: DataFrame, *group: str) -> DataFrame:
    """Means of the three scores in log lines; null if a run has none."""
    return lines.groupBy(*group).agg(*_scores())


def run_counts(lines: DataFrame, *group: str) -> DataFrame:
    """The last stream and cue counts that a run's log states."""
    return lines.groupBy(*group).agg(*_counts())


def run_summary(lines: DataFrame, *group: str) -> DataFrame:
    """Both of these in one pass over the lines."""
    return lines.groupBy(*group).agg(*_scores(), *_counts())
