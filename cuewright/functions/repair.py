"""Repair of recognised English text: confusions of letters, spacing, glued words.

Column expressions where regular expressions suffice.  What works word by word (confusions, corrections,
splitting of glued words by a dynamic programme over a dictionary) is an Arrow UDF, with the dictionary as
a broadcast of bounded size.  The dictionary and the common letter pairs come from a corpus (``learn``),
not from a list in the code.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Mapping
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .recognition import is_english
from .text import normalise_lines, space_after_punctuation, space_before_quote, space_letters_digits

#: At most so many words and letter groups are learnt: they bound the broadcast.
MAX_WORDS, MAX_PAIRS, MAX_TRIPLES = 50_000, 120, 400


class Lexicon(NamedTuple):
    words: frozenset[str]
    pairs: frozenset[str]
    triples: frozenset[str]
    costs: Mapping[str, int] = {}

    def likelihood(self, token: str) -> float:
        lower = token.lower()
        letters = "".join(c for c in lower if "a" <= c <= "z")
        bad = sum(not ("a" <= c <= "z" or c == "'") for c in lower)
        if len(letters) < 2:
            return -6.0 - 2.4 * bad
        gains = [1.0 if letters[k : k + 2] in self.pairs else -0.65 for k in range(len(letters) - 1)]
        gains += [1.3 if letters[k : k + 3] in self.triples else -0.85 for k in range(len(letters) - 2)]
        return max(sum(gains) / len(gains) - 0.45 * (len(letters) < 4) - 2.4 * bad, -6.0)


def learn(corpus: DataFrame, text: str = "text", *, min_count: int = 3) -> Lexicon:
    """Words of a corpus that occur ``min_count`` times or more, the commonest first, and letter groups.

    Counts are aggregations with partial sums; only the bounded tops come to the driver.
    """
    word = corpus.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & F.col("w").rlike("[a-z]")).persist()
    top = lambda df, k: [r[0] for r in df.orderBy(F.col("n").desc(), df.columns[0]).limit(k).collect()]

    def groups(size: int) -> DataFrame:
        spans = F.when(F.length("w") >= size, F.sequence(F.lit(1), F.length("w") - (size - 1)))
        each = word.select("n", F.explode(F.transform(spans, lambda i: F.substring(F.col("w"), i, F.lit(size)))).alias("g"))
        return each.filter(~F.contains("g", F.lit("'"))).groupBy("g").agg(F.sum("n").alias("n"))

    try:
        known = top(word, MAX_WORDS)
        return Lexicon(frozenset(known), frozenset(top(groups(2), MAX_PAIRS)), frozenset(top(groups(3), MAX_TRIPLES)), word_costs(known))
    finally:
        word.unpersist()


def glued(docs: DataFrame, word: str, text: str = "text") -> DataFrame:
    """(token): every two words of all texts glued together, a last one alone as it is.

    A text's words are a column, which the pairs take theirs from: each text is searched once, not for each pair.
    """
    found = docs.select(F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"))
    first = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda p: p["k"] % 2 == 0)
    pairs = F.transform(first, lambda p: F.concat(p["w"], F.coalesce(F.get("words", p["k"] + 1), F.lit(""))))
    return found.select(F.explode(pairs).alias("token"))


#: Letters of word ends that are looked up while a cut is sought; longer words are tried by their lengths.
WORD_END = 24


class Costs(dict[str, int]):
    """Costs of words, with the ends of words and the lengths of those longer than ``WORD_END``."""

    @cached_property
    def ends(self) -> frozenset[str]:
        return frozenset(w[-k:] for w in self for k in range(1, min(len(w), WORD_END) + 1))

    @cached_property
    def longer(self) -> list[int]:
        return sorted({len(w) for w in self if len(w) > WORD_END})


def word_costs(ranked: list[str]) -> Costs:
    """What a word costs in a cut, in millionths, by its rank among words that follow Zipf's law."""
    spread = math.log(max(len(ranked), 3))
    return Costs((w, math.floor(1_000_000 * math.log((k + 1) * spread))) for k, w in enumerate(ranked))


#: Digits read for letters, and marks read for letters, in order.
DIGIT_LETTERS = {"0": "o", "1": "l", "5": "s", "8": "b"}
#: Letters read for others; the first change that gives a known word is taken.
CONFUSIONS = [("v", "y"), ("f", "t"), ("hq", "n"), ("fh", "th"), ("cok", "ook"), ("f$", "th"), ("l$", "'ll"), ("oc", "c"), ("lo", "to")]
#: Words that recognition cuts apart.
FRAGMENTS = {
    "a sleep": "asleep", "any more": "anymore", "every thing": "everything", "my self": "myself", "your self": "yourself", "any way": "anyway",
    "so on enough": "soon enough", "so on,": "soon,", "so on.": "soon.", "yo u": "you", "me at": "meat", "could n't": "couldn't", "com ing": "coming", "liv ing": "living",
}


_TOKEN, _WORD = re.compile(r"[A-Za-z0-9'|]+"), re.compile(r"[A-Za-z']+")
_ORDINAL = re.compile(r"[lL](?=[0-9].*(?:st|nd|rd|th)$)", re.IGNORECASE | re.DOTALL)


def unconfused(token: str) -> str:
    """A token of letters, digits, apostrophes and bars with what recognition confuses put right.

    Where letters and digits meet, 0 1 5 8 are letters, but an l before the digits of an ordinal is a one;
    ``|`` is I and ``vv`` is w.  In a word with small letters a capital I, Q, O or N between or after small
    ones is the letter it looks like, judged by the letters beside it as they were.
    """
    if re.search("[A-Za-z]", token) and re.search("[0-9]", token):
        token = token.translate(str.maketrans(DIGIT_LETTERS))
    word = _ORDINAL.sub("1", token, count=1) if token[:1] in "lL" else token
    word = word.replace("|", "I").replace("vv", "w")
    if len(word) < 3 or not re.search("[a-z]", word):
        return word
    small = lambda c: "a" <= c <= "z"

    def looked_like(m: re.Match) -> str:
        c, before, after = m[0], word[m.start() - 1 : m.start()], word[m.end() : m.end() + 1]
        if c == "I":
            if small(before):
                return "l" if before in "uo" and after == "d" else "i" if not after or after == "I" or small(after) else c
            return "l" if before == "I" and small(after) else c
        if c == "N":
            return "n" if small(before) and not after and not "A" <= word[0] <= "Z" else c
        return c.lower().replace("q", "u") if small(before) else c

    return re.sub("[IQON]", looked_like, word)


def unfragmented(text: Column) -> Column:
    """Words cut apart joined again, whole words only, the first letter's case kept."""
    for was, now in FRAGMENTS.items():
        start, rest = was[0], "".join(f"\\{c}" if c in ".,'" else c for c in was[1:])
        end = "" if was[-1] in ".," else r"(?![A-Za-z0-9'])"
        for first in {start, start.upper()}:
            out_first = now[0].upper() if first.isupper() else now[0]
            text = F.regexp_replace(text, rf"(?<![A-Za-z0-9']){first}(?i:{rest}){end}", out_first + now[1:])
    return text


#: Words that have one correction.
CORRECTIONS = {"atl": "at", "exhusband": "ex-husband"}


def _cased(original: str, new: str) -> str:
    if re.fullmatch("[A-Z]+", original):
        return new.upper()
    return new[:1].upper() + new[1:] if original[:1].isupper() else new


def corrected(word: str, lexicon: Lexicon) -> str:
    """A word of three letters or more that is not known, changed to the first known candidate."""
    lower = word.lower()
    if len(word) < 3 or lower in lexicon.words:
        return word
    if lower in CORRECTIONS:
        return _cased(word, CORRECTIONS[lower])
    for was, now in CONFUSIONS:
        candidate = lower[: -len(was) + 1] + now if was.endswith("$") and lower.endswith(was[:-1]) else lower.replace(was, now)
        if candidate != lower and candidate in lexicon.words:
            return _cased(word, candidate)
    return word


def _piece(piece: str, lexicon: Lexicon) -> int | None:
    """What a dictionary piece costs beside its length; None if it is none."""
    if piece in lexicon.words:
        return 0
    if "'" not in piece:
        return None
    if piece == "'em":
        return -2
    for suffix, least in (("'s", 3), ("'", 3), ("n't", 2)):
        if piece.endswith(suffix) and len(piece) - len(suffix) >= least and piece[: -len(suffix)] in lexicon.words:
            return -1
    return None


def split_known(word: str, lexicon: Lexicon) -> list[str] | None:
    """The best cut of a glued word into dictionary pieces of up to 16 characters; None for fewer than two."""
    lower, n = word.lower(), len(word)
    if n < 4 or lower in lexicon.words:
        return None
    best: list[tuple[int, int, int] | None] = [(0, 0, 0), *[None] * n]  # score, minus pieces, begin
    for end in range(1, n + 1):
        for begin in range(max(0, end - 16), end):
            if best[begin] is None:
                continue
            piece = lower[begin:end]
            if len(piece) == 1 and piece not in "ia" or (extra := _piece(piece, lexicon)) is None:
                continue
            gain = 10 * len(piece) - 8 + extra - 6 * (len(piece) <= 2) + 6 * (len(piece) >= 4) + 4 * ("'" in piece)
            own = (best[begin][0] + gain, best[begin][1] - 1, begin)
            if best[end] is None or own[:2] > best[end][:2]:
                best[end] = own
    return _pieces(word, best) if best[n] is not None and best[n][1] <= -2 else None


#: Words of one or two letters that a cut may hold, and words that a capital may begin.
SHORT_WORDS = frozenset("a i am an as at be by do go he if in is it me my no of on or so to up us we".split())
FIRST_WORDS = frozenset("but the why who what when where how let if it is you book".split())


def cheapest_cut(lower: str, costs: Mapping[str, int]) -> list[str] | None:
    """The cut into known words of the least cost together, the last word the shorter one of equals; None if there is none."""
    costs = costs if isinstance(costs, Costs) else Costs(costs)
    ends, longer = costs.ends, costs.longer
    best: list[tuple[int, int] | None] = [(0, 0), *[None] * len(lower)]  # cost, length of the last word
    for end in range(1, len(lower) + 1):
        own: tuple[int, int] | None = None
        for k in itertools.chain(range(1, min(end, WORD_END) + 1), longer):
            if k > end or k <= WORD_END and lower[end - k : end] not in ends:
                break  # no known word ends like this
            if (before := best[end - k]) is not None and (cost := costs.get(lower[end - k : end])) is not None:
                own = min(own, (before[0] + cost, k)) if own else (before[0] + cost, k)
        best[end] = own
    out, end = [], len(lower)
    while end and best[end] is not None:
        out.append(lower[end - best[end][1] : end])
        end -= best[end][1]
    return None if end else out[::-1]


def split_probable(word: str, lexicon: Lexicon) -> list[str] | None:
    """The cheapest cut of a glued word of eight letters or more; None if what it gives is unlike words.

    So is a piece of one or two letters that is no common word, an ``a`` after a long first word, a short
    unknown first word with a capital before three others, and six pieces or more of hardly three letters.
    """
    if len(word) < 8 or not word.isascii():
        return None
    small = cheapest_cut(word.lower(), lexicon.costs)
    if small is None or len(small) < 2 or any(len(p) <= 2 and p not in SHORT_WORDS for p in small):
        return None
    first = small[0]
    if small[1] == "a" and len(first) >= 4 and first not in FIRST_WORDS:
        return None
    if "A" <= word[0] <= "Z" and len(first) <= 3 and first not in SHORT_WORDS | FIRST_WORDS and len(small) > 3:
        return None
    if len(small) >= 6 and len(word) / len(small) < 3.2 or any(len(p) >= 3 and lexicon.likelihood(p) < -2.2 for p in small):
        return None
    out, at = [], 0
    for p in small:
        out.append(word[at : at + len(p)])
        at += len(p)
    return out


def split_after_title(word: str, lexicon: Lexicon) -> list[str] | None:
    """A capitalised word of twelve letters or more cut after five to ten of them, if the rest is three words or more."""
    if len(word) < 12 or not word.isascii() or not "A" <= word[0] <= "Z":
        return None
    for k in range(5, min(len(word), 10) + 1):
        head, rest = word[:k], word[k:]
        if len(rest) < 8 or not "a" <= rest[0] <= "z":
            continue
        cut = split_known(rest, lexicon) or split_probable(rest, lexicon)
        if cut and len(cut) >= 3 and lexicon.likelihood(head) >= -1.2:
            return [head, *cut]
    return None


def split_likely(word: str, lexicon: Lexicon) -> list[str] | None:
    """A cut by letter-group likelihood where no dictionary cut is found; None unless it clearly gains."""
    lower, n = word.lower(), len(word)
    whole = lexicon.likelihood(lower)
    if n < 5 or whole > -0.2:
        return None
    best: list[tuple[float, int, int] | None] = [(0.0, 0, 0), *[None] * n]
    for end in range(2, n + 1):
        for begin in range(max(0, end - 12), end - 1):
            if best[begin] is None:
                continue
            size = end - begin
            score = best[begin][0] + lexicon.likelihood(lower[begin:end]) - (0.9 if size < 3 else 0.2 if size == 3 else 0.0)
            old = best[end]
            if old is None or score > old[0] + 0.001 or abs(score - old[0]) <= 0.001 and best[begin][1] - 1 > old[1]:
                best[end] = (score, best[begin][1] - 1, begin)
    if best[n] is None or best[n][1] > -2 or best[n][0] < whole + 0.35:
        return None
    cut = _pieces(word, best)
    if len(cut) >= 5 and n / len(cut) < 2.6 or any(lexicon.likelihood(p) < -2.4 for p in cut):
        return None
    return cut


def _pieces(word: str, best: list) -> list[str]:
    out, end = [], len(word)
    while end:
        begin = best[end][2]
        out.append(word[begin:end])
        end = begin
    return out[::-1]


#: Fixed value: letters of a piece that may be glued still.
RESIDUAL = 12


def split_word(word: str, lexicon: Lexicon, probable: bool = False) -> str:
    """A glued word cut by case, dictionary, contraction or likelihood, in this order; else itself.

    With ``probable`` the cheapest cut by word costs replaces a dictionary cut with a long piece, and comes
    before contractions where there is no dictionary cut.
    """
    if len(word) < 4:
        return word
    for k in range(2, len(word) - 1):
        if word[k - 1].islower() and word[k].isupper() and any(c.islower() for c in word[k + 1 :]):
            head, tail = word[:k], word[k:]
            if head.lower() in lexicon.words or split_known(head, lexicon) or lexicon.likelihood(head) > -1.5:
                return " ".join([*(split_known(head, lexicon) or [head]), *(split_known(tail, lexicon) or [tail])])
    if cut := split_known(word, lexicon):
        if probable and any(sum(c.isalpha() for c in p) >= RESIDUAL for p in cut):
            cut = split_probable(word, lexicon) or cut
        return " ".join(cut)
    if probable and (cut := split_probable(word, lexicon) or split_after_title(word, lexicon)):
        return " ".join(cut)
    head, mark, tail = word.partition("'")
    for suffix in ("s", "re", "ve", "ll", "d", "m", "t"):
        if head and mark and tail.lower().startswith(suffix) and len(tail) - len(suffix) >= 2 and tail.isalpha():
            rest = tail[len(suffix) :]
            return " ".join([head + mark + tail[: len(suffix)], *(probable and split_probable(rest, lexicon) or split_likely(rest, lexicon) or [rest])])
    return " ".join(split_likely(word, lexicon) or [word])


#: How many words are tried as one, the least length of them together, and what makes one suspect.
FEWEST, MOST, LEAST_LENGTH, LONG, SHORT = 2, 12, 8, 12, 3


def rejoined(text: str, split: Callable[[str], str]) -> str:
    """Words cut at the wrong places joined and cut anew, on one line.

    Plain words up to one with a mark after it are a run.  A run with a suspect word (long, a capital after
    a small letter, or short with a capital) is taken as one word; its cut is kept if it has as many words
    as the run or more.
    """
    out: list[str] = []
    run: list[re.Match] = []

    def close() -> None:
        cores = [m[2] for m in run]
        joined = "".join(cores)
        suspect = any(len(c) >= LONG or re.search("[a-z][A-Z]", c) or len(c) <= SHORT and re.search("[A-Z]", c) for c in cores)
        cut = split(joined) if FEWEST <= len(run) <= MOST and suspect and len(joined) >= LEAST_LENGTH else joined
        if " " in cut and len(cut.split()) >= len(run):
            out.append(run[0][1] + cut + run[-1][3])
        else:
            out.extend(m[0] for m in run)
        run.clear()

    for raw in text.split():
        m = re.fullmatch(r"([^A-Za-z']*)([A-Za-z']+)([^A-Za-z']*)", raw)
        if m is None or not re.search("[A-Za-z]", m[2]):
            close()
            out.append(raw)
            continue
        run.append(m)
        if m[3]:
            close()
    close()
    return " ".join(out)


def postprocess(lexicon_broadcast, text: Column, language: Column, probable: bool = False) -> Column:
    """English text repaired in a fixed order; other languages are normalised alone. ``probable`` is as in ``split_word``.

    Word by word in Arrow UDFs, equal words once a batch; spacing and fragments as native expressions.
    """

    @F.pandas_udf(StringType())
    def fixed(texts: pd.Series, step: pd.Series) -> pd.Series:
        lexicon, known = lexicon_broadcast.value, {}

        def change(name: str, word: str) -> str:
            if (name, word) not in known:
                known[name, word] = {"confused": unconfused, "wrong": lambda w: corrected(w, lexicon), "glued": lambda w: split_word(w, lexicon, probable)}[name](word)
            return known[name, word]

        by_word = lambda form, name, t: form.sub(lambda m: change(name, m[0]), t)

        def whole(t: str, name: str) -> str:
            if name == "words":
                return by_word(_WORD, "wrong", by_word(_TOKEN, "confused", t))
            return by_word(_WORD, "glued", t) if name == "glued" else rejoined(t, lambda w: change("glued", w))

        return pd.Series([None if t is None else whole(t, n) for t, n in zip(texts, step, strict=True)])

    clean = normalise_lines(text)
    spaced = space_before_quote(space_letters_digits(space_after_punctuation(fixed(clean, F.lit("words")))))
    whole = normalise_lines(unfragmented(fixed(unfragmented(fixed(spaced, F.lit("runs"))), F.lit("glued"))))
    return F.when(is_english(language), whole).otherwise(clean)


@F.pandas_udf(StringType())
def unconfused_text(texts: pd.Series) -> pd.Series:
    """``unconfused`` for each token of a text."""
    return pd.Series([None if t is None else _TOKEN.sub(lambda m: unconfused(m[0]), t) for t in texts])


def cut_words(lexicon_broadcast, words: Column) -> Column:
    """``split_probable`` of each word, its pieces joined by spaces; null where there is no cut."""

    @F.pandas_udf(StringType())
    def cut(own: pd.Series) -> pd.Series:
        lexicon = lexicon_broadcast.value
        return pd.Series([None if w is None or (p := split_probable(w, lexicon)) is None else " ".join(p) for w in own], dtype=object)

    return cut(words)
