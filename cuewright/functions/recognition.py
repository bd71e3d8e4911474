"""Expressions over recognised text and recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import counted_texts
from .media import box_area
from .text import WS, ascii_lower, let, normalise_lines, strip

#: Words of one or two letters that are no sign of noise.
SHORT_WORDS = "a i am an as at be by do go he if in is it me my no of on or so to up us we".split()
#: Languages written without spaces.
UNSPACED = ("jpn", "ja", "zho", "zh", "chi", "chi_sim", "chi_tra", "tha", "th")
MAX_HEIGHT_TO_WIDTH = 4.0


def uses_spaces(language: Column) -> Column:
    return ~F.coalesce(ascii_lower(strip(language)).isin(*UNSPACED), F.lit(False))


def is_english(language: Column) -> Column:
    return F.coalesce(ascii_lower(strip(language)).isin("eng", "en", "en-us", "en_us"), F.lit(False))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def of_class(text: Column, one: str) -> Column:
    """How many characters are of a class: what the text loses with its runs, with no array of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{one}+", ""))


def camel(word: Column) -> Column:
    return word.rlike("[a-z][A-Z]")


def _over(value: Column, start: float, factor: float, most: float) -> Column:
    """A penalty that begins over ``start`` and is at most ``most``."""
    return F.when(value > start, F.least((value - start) * factor, F.lit(most))).otherwise(0.0)


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def bare_words(spaced: Column) -> Column:
    """The words of a text with single spaces, without what is no letter or apostrophe at their ends, a space
    before each; words of other than ASCII are left out."""
    core = r"[^A-Za-z' ]*+([A-Za-z'](?:[\x00-\x1F!-\x7F]*[A-Za-z'])?)[^A-Za-z' ]*+(?= |$)"
    return F.regexp_replace(F.concat(F.lit(" "), spaced), rf" (?:{core}|[^ ]*+)", " $1")


def _statistics(clean: Column, spaced: Column, bare: Column) -> Column:
    """What the score needs of a normalised text, its single-spaced form and its bare words."""
    count = lambda p: of_class(clean, p)
    matches = lambda text, p: F.regexp_count(text, F.lit(p))
    octets = F.decode(F.encode(spaced, "UTF-8"), "ISO-8859-1")  # a character for each byte
    return F.struct(
        F.length(clean).alias("chars"), count(r"\p{IsAlphabetic}").alias("letters"), count("[0-9]").alias("digits"), count(WS).alias("spaces"), count(r"[!-/:-@\[-`{-~“”‘’…]").alias("marks"),
        F.greatest(matches(spaced, "[^ ]+"), F.lit(1)).alias("words"), matches(octets, "[^ ]{14,}").alias("long"), F.contains(clean, F.lit("@&")).alias("glitch"), F.contains(clean, F.lit("|")).alias("bar"),
        F.nullif(matches(bare, "[^ ]+"), F.lit(0)).alias("ascii"), matches(bare, rf"(?<= )(?!(?i:{'|'.join(SHORT_WORDS)})(?: |$))[^ ]{{1,2}}(?= |$)").alias("short"), matches(bare, r"(?<= )(?=[^ ]*[a-z][A-Z])[^ ]+").alias("camel"),
    )


def _score(s: Column, spaced: Column) -> Column:
    total = F.greatest(s["chars"], F.lit(1)).cast("double")
    space_rate = s["spaces"] / total
    glued = (
        F.when((s["letters"] >= 12) & (s["words"] <= 1), 0.35).otherwise(0.0)
        + _over(s["letters"] / s["words"], 10.5, 0.035, 0.22)
        + _over(s["long"] / s["words"], 0.12, 0.65, 0.35)
        + F.when((s["letters"] >= 80) & (space_rate < 0.08), F.least((0.08 - space_rate) * 3.0, F.lit(0.25))).otherwise(0.0)
        + F.coalesce(_over(s["short"] / s["ascii"], 0.06, 1.2, 0.30), F.lit(0.0))
        + F.coalesce(_over(s["camel"] / s["ascii"], 0.02, 1.0, 0.20), F.lit(0.0))
    )
    noise = (s["chars"] - s["letters"] - s["digits"] - s["spaces"] - s["marks"]) / total * 1.2
    score = 1.0 - noise - F.when(s["glitch"], 0.18).otherwise(0.0) - F.when(s["bar"], 0.12).otherwise(0.0) - F.when(spaced, glued).otherwise(0.0) - F.when((s["letters"] == 0) & (s["digits"] == 0), 0.3).otherwise(0.0)
    return F.when(s["chars"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + F.least(s["letters"] / 24.0, F.lit(0.2)))))


def quality_score(text: Column, spaced: Column) -> Column:
    """How much a text looks like language, from 0 to 1; 0 for an empty one.

    ``spaced``: whether its language separates words by spaces.  For lines, and inside other expressions;
    whole documents are scored faster by ``with_quality``.
    """
    own = lambda clean: let(single_spaced(clean), lambda single: let(bare_words(single), lambda bare: let(_statistics(clean, single, bare), lambda s: _score(s, spaced))))
    return let(normalise_lines(text), own)


def with_quality(rows: DataFrame, text: Column, spaced: Column, name: str = "quality", run: str | None = None) -> DataFrame:
    """Adds the score of whole documents as a column, from counts that one pass over a batch of texts makes.

    ``run`` names a further column: whether a text has a letter token of 14.  Null texts have null results.
    """
    made = rows.withColumn("_s", counted_texts(text, SHORT_WORDS))
    scored = made.withColumn(name, F.when(F.col("_s").isNotNull(), _score(F.col("_s"), spaced)))
    return (scored.withColumn(run, F.col("_s.run")) if run else scored).drop("_s")


def joined_lines(lines: Column) -> Column:
    """The texts of recognised lines that are not blank, joined by spaces and normalised."""
    texts = F.filter(F.transform(lines, lambda x: strip(x["text"])), lambda t: t != "")
    return normalise_lines(F.array_join(texts, " "))


def confidence(lines: Column) -> Column:
    """The mean score weighted by box area, or by characters where a line has no box; null without scores."""
    weight = lambda x: F.when(box_area(x["bbox"]) > 0, box_area(x["bbox"])).otherwise(F.greatest(F.length(F.regexp_replace(x["text"], f"{WS}", "")), F.lit(1))).cast("double")
    scored = F.filter(lines, lambda x: x["score"].isNotNull() & ~F.isnan(x["score"]) & (F.abs(x["score"]) < float("inf")))
    add = lambda f: F.aggregate(scored, F.lit(0.0), lambda s, x: s + f(x))
    return F.try_divide(add(lambda x: x["score"].cast("double") * weight(x)), add(weight))


def alpha_count(text: Column) -> Column:
    return of_class(text, r"\p{IsAlphabetic}")


def spacing_fallback(lines: Column) -> Column:
    """Whether recognised lines look glued: long letter tokens where spaces should be."""
    texts = F.transform(lines, lambda x: strip(x["text"]))
    tokens = F.flatten(F.transform(texts, lambda t: F.split(t, r"[^\p{IsAlphabetic}']+")))
    long_tokens = F.size(F.filter(tokens, lambda t: alpha_count(t) >= 14)) + F.size(F.filter(texts, lambda t: ~F.contains(t, F.lit(" ")) & (alpha_count(t) >= 12)))
    spaced, lettered = F.exists(texts, lambda t: F.contains(t, F.lit(" "))), F.exists(texts, lambda t: alpha_count(t) > 0)
    very_long = F.exists(tokens, lambda t: alpha_count(t) >= 20)
    return F.coalesce(lettered & ((~spaced & (long_tokens > 0)) | very_long | (long_tokens >= 2)), F.lit(False))


def _tall(x: Column) -> Column:
    width, height = F.greatest(x["bbox"]["right"] - x["bbox"]["left"], F.lit(0)), F.greatest(x["bbox"]["bottom"] - x["bbox"]["top"], F.lit(0))
    return F.coalesce((width > 0) & (height > 0) & (height / width > MAX_HEIGHT_TO_WIDTH), F.lit(False))


def pruned(lines: Column, language: Column) -> Column:
    """struct(lines, dropped): without boxes far too tall for a spaced language; lines without a box stay."""
    kept = F.when(uses_spaces(language), F.filter(lines, lambda x: ~_tall(x))).otherwise(lines)
    return F.struct(kept.alias("lines"), (F.size(lines) - F.size(kept)).alias("dropped"))


def geometry_fallback(lines: Column, language: Column) -> Column:
    return uses_spaces(language) & F.coalesce(F.exists(lines, lambda x: _tall(x) & (alpha_count(x["text"]) >= 5)), F.lit(False))


def quality_fallback(lines: Column, language: Column, quality: Column | None = None, spacing: Column | None = None, geometry: Column | None = None) -> Column:
    """Whether another recogniser should be asked: spacing, geometry or quality under 0.45.

    ``quality`` (of the joined lines), ``spacing`` and ``geometry``: where they are known already.
    """
    low = (quality_score(joined_lines(lines), uses_spaces(language)) if quality is None else quality) < 0.45
    glued = spacing_fallback(lines) if spacing is None else spacing
    return (F.size(lines) > 0) & (glued | (geometry_fallback(lines, language) if geometry is None else geometry) | low)


def residual_fallback(processed: Column, language: Column) -> Column:
    """Whether any processed line still looks wrong: few spaces, short garbage, long or camel tokens."""
    texts = F.filter(F.transform(processed, strip), lambda t: t != "")

    def wrong(t: Column) -> Column:
        tokens = F.filter(F.flatten(F.transform(words(t), lambda w: F.split(w, "[^A-Za-z']+"))), lambda p: p != "")
        alpha = F.regexp_count(t, F.lit("[A-Za-z]"))
        n = F.length(t)
        long_token = F.exists(tokens, lambda p: F.regexp_count(p, F.lit("[A-Za-z]")) >= 12)
        sparse = (alpha >= 18) & (F.regexp_count(t, F.lit(WS)) / F.greatest(F.octet_length(t), F.lit(1)) < 0.06)
        garbage = (n <= 12) & (alpha <= 4) & (alpha / F.greatest(n, F.lit(1)) < 0.75)
        weak = (F.size(words(t)) <= 2) & (quality_score(t, F.lit(True)) < 0.70)
        return sparse | garbage | weak | long_token | F.exists(tokens, camel)

    return uses_spaces(language) & F.exists(texts, wrong)


def exportable_label(text: Column, spaced: Column, quality: Column | None = None, run: Column | None = None) -> Column:
    """Whether a line may train a recogniser: quality of 0.72 and no letter token of 14.

    ``quality`` and ``run``: the text's score and whether it has such a token, where they are known already.
    """
    return ((quality_score(text, spaced) if quality is None else quality) >= 0.72) & ~(text.rlike(r"(?:\p{IsAlphabetic}'*+){14}") if run is None else run)


def quality_after(processed: Column, language: Column) -> Column:
    """The quality of a recognition result after repair: its processed lines, blank ones left out, as one text."""
    texts = F.filter(F.transform(processed, strip), lambda t: t != "")
    return quality_score(normalise_lines(F.array_join(texts, " ")), uses_spaces(language))


def recovery_taken(quality: Column, raw: Column) -> Column:
    """Word-by-word recovery is taken if it gains over 0.03."""
    return F.coalesce(quality > raw + 0.03, F.lit(False))


def box_union(boxes: Column) -> Column:
    side = lambda f, name: f(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.struct(side(F.array_min, "left"), side(F.array_min, "top"), side(F.array_max, "right"), side(F.array_max, "bottom"))


def likelihood(token: Column, bigrams: list[str], trigrams: list[str]) -> Column:
    """A mean over a token's letter pairs and triples: +1 / -0.65 and +1.3 / -0.85 for common and rare ones.

    Under four letters cost 0.45, characters other than letters and apostrophes 2.4 each; not below -6.
    """
    lower = ascii_lower(token)
    letters = F.regexp_replace(lower, "[^a-z]", "")
    bad = F.length(F.regexp_replace(lower, "[a-z']", ""))
    n = F.length(letters)

    def total(size: int, common: list[str], plus: float, minus: float) -> Column:
        grams = F.transform(F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(letters, i, F.lit(size)))
        return F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.when(g.isin(common), plus).otherwise(-minus))

    samples = F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    mean = (total(2, bigrams, 1.0, 0.65) + total(3, trigrams, 1.3, 0.85)) / F.nullif(samples, F.lit(0))
    return F.when(n < 2, -6.0 - bad * 2.4).otherwise(F.greatest(mean - F.when(n < 4, 0.45).otherwise(0.0) - bad * 2.4, F.lit(-6.0)))
