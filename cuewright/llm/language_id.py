"""Language identification by cross-parsing entropy.

From labelled text a suffix automaton is built for each language.  A text is parsed greedily with
each automaton: a phrase is the longest match from where it begins, and a symbol that no match
takes further begins the next one.  Phrases of a language cost log2 of its training length each;
the language with the least cost wins.

Training reads a bounded sample: from each language the documents with the smallest id hash in
``sample_docs`` hash classes, until ``train_chars`` symbols are filled.  The sample bounds the
automata (about 2 * train_chars states each).  They are sent to the tasks in blocks of languages of at
most ``sent_bytes``, each a pass over the texts, which are written down with the best language so far
between two passes; a dozen languages are one block.  Every document is scored whole.  Every letter is a symbol of its own; the ``alphabet`` commonest have a column in the
automata's table, others are looked up in a sorted list of transitions.

A text is stepped through in blocks of ``block`` symbols, thousands of blocks at a time.  Each block
is first parsed as if a phrase began there.  Then the parse of the block before is carried on into it
until both parses begin a phrase at the same symbol, from where on they are one.  So the count is that
of one parse of the whole text, whatever ``block`` is.

Defined results: a null text or one without a letter is ``und`` with score 0; without any training
text all are ``und``; equal costs go to the language that sorts first.  Columns besides id and text
are ignored; rows that repeat an id are each scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, thrifty
from .text_arrays import row_slices

TRAIN_CHARS = 30_000
SAMPLE_DOCS = 32
ALPHABET = 62
#: Automata that are sent to the tasks at once.
SENT_BYTES = 128 << 20
#: Places of a table from which they are numbered in 64 bits.
WIDE = 2**31
#: The symbol of a letter without a column, in the grid of symbols.
OTHER = 255
#: Texts are stepped through together in groups of about so many symbols.
GROUP_CHARS = 8 << 20


class SuffixAutomaton:
    """All substrings of a symbol sequence, one state a class of end positions."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state

    def table(self, size: int) -> tuple[np.ndarray, dict[tuple[int, int], int], dict[int, int]]:
        """Per state and symbol: twice the next state, plus 1 if a new phrase begins there.

        Symbols under ``size`` have a column; of the others the transitions, and those of the root.
        """
        start = np.zeros(size, np.int32)
        for c, to in self.next[0].items():
            if c < size:
                start[c] = to
        out = np.tile(start * 2 + 1, (len(self.next), 1))  # from the root each symbol begins a phrase
        more: dict[tuple[int, int], int] = {}
        for state, edges in enumerate(self.next[1:], 1):
            for c, to in edges.items():
                if c < size:
                    out[state, c] = to * 2
                else:
                    more[state, c] = to
        return out, more, {c: to for c, to in self.next[0].items() if c >= size}


class Lookup:
    """Sorted (state, symbol) keys with what they lead to."""

    def __init__(self, found: dict[tuple[int, int], int]) -> None:
        rows = sorted((state << 22 | c, to) for (state, c), to in found.items())
        self.keys, self.to = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))

    def get(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """-1 where there is no such key."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = state << 22 | symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def is_letter(point: int) -> bool:
    """Letters, and the marks that are written with them."""
    return chr(point).isalpha() or unicodedata.category(chr(point))[0] == "M"


def common_letters(texts: dict[str, list[str]], alphabet: int) -> np.ndarray:
    """The commonest letters of all texts, in the order of their code points."""
    points, counts = np.unique(_points("".join(t for lang in sorted(texts) for t in texts[lang]).lower()), return_counts=True)
    letters = [(-n, p) for p, n in zip(points.tolist(), counts.tolist(), strict=True) if is_letter(p)]
    return np.array(sorted(p for _, p in sorted(letters)[: min(alphabet, OTHER - 1)]), np.int64)


class CrossParser:
    """Automata of some languages as one table over a common alphabet."""

    def __init__(self, texts: dict[str, list[str]], train_chars: int = TRAIN_CHARS, alphabet: int = ALPHABET, points: np.ndarray | None = None) -> None:
        self.langs = sorted(texts)
        self.points = common_letters(texts, alphabet) if points is None else points
        # symbols: 0 white space and all that is no letter, 1 .. letters with a column, then size + code point
        self.size = len(self.points) + 1
        tables, self.base, self.bits, at = [], [], [], 0
        more: dict[tuple[int, int], int] = {}
        first: dict[tuple[int, int], int] = {}
        for k, lang in enumerate(self.langs):
            symbols = np.concatenate([self.symbols(t) for t in texts[lang]] or [np.zeros(0, np.int64)])[:train_chars]
            table, others, roots = SuffixAutomaton(symbols.tolist()).table(self.size)
            tables.append(table.astype(np.int64) + 2 * at)
            more |= {((state + at) * self.size, c): (to + at) * self.size for (state, c), to in others.items()}
            first |= {(k, c): (to + at) * self.size for c, to in roots.items()}
            self.base.append(at)
            self.bits.append(np.log2(max(2, len(symbols))))
            at += len(table)
        # a step gives the next row's place in the flat table, doubled, plus the new-phrase bit
        flat = np.concatenate(tables) if tables else np.zeros((0, self.size), np.int64)
        self.flat = ((flat >> 1) * self.size * 2 | (flat & 1)).astype(np.int32 if 2 * flat.size < WIDE else np.int64).ravel()
        self.more, self.first = Lookup(more), Lookup(first)

    def symbols(self, text: str) -> np.ndarray:
        points = _points(text.lower())
        at = np.minimum(np.searchsorted(self.points, points), max(len(self.points) - 1, 0))
        known = self.points[at] == points if len(self.points) else np.zeros(len(points), bool)
        out = np.where(known, at + 1, 0)
        odd = np.flatnonzero(~known & ((points >= 128) | ((points >= 97) & (points <= 122))))
        if len(odd):
            values, back = np.unique(points[odd], return_inverse=True)
            out[odd] = np.array([self.size + v if is_letter(v) else 0 for v in values.tolist()])[back]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]

    def phrases(self, texts: list[np.ndarray], block: int) -> np.ndarray:
        """Numbers of phrases, a row a text and a column a language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = np.maximum(-(-sizes // block), 1)
        owner = np.repeat(np.arange(len(texts)), blocks)
        total = int(blocks.sum())
        firsts = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        lengths = np.full(total, block, np.int64)
        lengths[firsts + blocks - 1] = sizes - (blocks - 1) * block
        grid = np.zeros((total, block), np.uint8)
        flat = grid.reshape(-1)
        places, points = [], []
        for at, symbols in zip((firsts * block).tolist(), texts, strict=True):
            flat[at : at + len(symbols)] = np.where(symbols >= self.size, OTHER, symbols)
            odd = np.flatnonzero(symbols >= self.size)
            places.append(odd + at)
            points.append(symbols[odd])
        odd_at, odd_symbol = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, points))
        order = np.argsort(-lengths, kind="stable")  # blocks that still go on come first
        lane = np.empty(total, np.int64)
        lane[order] = np.arange(total)
        steps = np.ascontiguousarray(grid[order].T)
        live = np.searchsorted(-lengths[order], -np.arange(block), "left")
        opening = np.zeros(total, bool)
        opening[firsts] = True
        counts = np.zeros((total, len(self.langs)), np.int64)

        def advance(k: int, state: np.ndarray, step: int, which: slice | np.ndarray) -> np.ndarray:
            """Twice the next place, plus the new-phrase bit."""
            symbol = steps[step, which]
            if not len(odd_at):
                return self.flat.take(state + symbol)
            odd = np.flatnonzero(symbol == OTHER)
            found = self.flat.take(state + np.where(symbol == OTHER, 0, symbol))
            if len(odd):
                lanes = np.arange(total)[which][odd]
                own = odd_symbol[np.searchsorted(odd_at, order[lanes] * block + step)]
                to = self.more.get(state[odd].astype(np.int64), own)
                new = self.first.get(np.full(len(odd), k), own)
                new = np.where(new < 0, self.base[k] * self.size, new) * 2 + 1
                found[odd] = np.where(to >= 0, to * 2, new)
            return found

        for k, base in enumerate(self.base):
            end = np.full(total, base * self.size, self.flat.dtype)
            begins = np.zeros((block, total), bool)
            for step in range(block):
                n = live[step]
                if not n:
                    break
                found = advance(k, end[:n], step, slice(0, n))
                begins[step, :n] = found & 1
                end[:n] = found >> 1
            alone, alone_end = begins.sum(0), end.copy()
            seen = alone.copy()
            todo = np.flatnonzero(~opening)
            while len(todo):
                lanes, state = lane[todo], end[lane[todo - 1]]
                change, met = np.zeros(len(todo), np.int64), np.zeros(len(todo), bool)
                going = np.arange(len(todo))
                for step in range(block):
                    going = going[lengths[todo[going]] > step]
                    if not len(going):
                        break
                    found = advance(k, state[going], step, lanes[going])
                    one, other = (found & 1).astype(bool), begins[step, lanes[going]]
                    change[going] += one.astype(np.int64) - other
                    state[going] = found >> 1
                    met[going[one & other]] = True
                    going = going[~(one & other)]
                seen[lanes] = alone[lanes] + change
                # a block that is left in another state than was taken for it enters the next one anew
                left = np.where(met, alone_end[lanes], state)
                after = todo[left != end[lanes]] + 1
                end[lanes] = left
                after = after[after < total]
                todo = after[~opening[after]]
            counts[:, k] = seen
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(out, owner[order], counts)
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, train_chars: int) -> DataFrame:
    """(lang, h, text): in each language the document of smallest hash in each hash class.

    The id, language and hash alone are aggregated (partially first); texts are read for the few
    chosen rows only, one for each id, and of each as much as can fill the training.
    """
    hashed = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    chosen = hashed.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("class")).agg(F.min(F.struct("h", "id")).alias("least")).select("lang", "least.h", "least.id").collect()
    # at most languages * sample_docs ids
    wanted = hashed.filter(F.col("id").isin([r.id for r in chosen]) if chosen else F.lit(False))
    return wanted.select("lang", "h", F.substring("text", 1, 2 * train_chars).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))


class Languages:
    """The training texts of all languages, and their automata in blocks."""

    def __init__(self, texts: dict[str, list[str]], train_chars: int = TRAIN_CHARS, sent_bytes: int = SENT_BYTES) -> None:
        self.langs, self.texts, self.train_chars, self.sent_bytes = sorted(texts), texts, train_chars, sent_bytes

    def parsers(self) -> Iterator[CrossParser]:
        """The automata of a block of languages after the other, in the order of their names; at least one."""
        points = common_letters(self.texts, ALPHABET)
        held: list[str] = []
        size = 0
        for lang in self.langs:
            # two states a symbol at most, a row of places each
            own = 2 * min(self.train_chars, sum(map(len, self.texts[lang]))) * (len(points) + 1) * 4
            if held and size + own > self.sent_bytes:
                yield CrossParser({x: self.texts[x] for x in held}, self.train_chars, points=points)
                held, size = [], 0
            held.append(lang)
            size += own
        yield CrossParser({x: self.texts[x] for x in held}, self.train_chars, points=points)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, train_chars: int = TRAIN_CHARS, sent_bytes: int = SENT_BYTES) -> Languages:
    texts: dict[str, list[str]] = {}
    filled: dict[str, int] = {}
    for row in sorted(training_sample(labelled, id_col, text_col, lang_col, sample_docs, train_chars).dropna().collect()):
        if filled.get(row.lang, 0) < train_chars:
            texts.setdefault(row.lang, []).append(row.text)
            filled[row.lang] = filled.get(row.lang, 0) + len(row.text)
    return Languages(texts, train_chars, sent_bytes)


def judge(texts: list[str | None], lettered: list[bool], parser: CrossParser, block: int) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Of each text the parser's language of least cost, that cost, and all languages' odds together, the best one's being 1.

    Texts that are not judged have no language and an infinite cost.
    """
    lang, least, odds = [None] * len(texts), np.full(len(texts), np.inf), np.zeros(len(texts))
    if not parser.langs:
        return lang, least, odds
    todo = [k for k, ok in enumerate(lettered) if ok and texts[k] is not None]
    group: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def close() -> None:
        costs = parser.phrases(held, block) * np.array(parser.bits)
        best = costs.argmin(1)
        least[group] = costs[np.arange(len(held)), best]
        odds[group] = np.exp2(-np.minimum(costs - least[group][:, None], 60)).sum(1)  # each bit of cost halves them
        for k, b in zip(group, best.tolist(), strict=True):
            lang[k] = parser.langs[b]

    for k in todo:
        symbols = parser.symbols(texts[k])
        group.append(k)
        held.append(symbols)
        size += len(symbols)
        if size >= GROUP_CHARS:
            close()
            group, held, size = [], [], 0
    if group:
        close()
    return lang, least, odds


#: Names of what ``with_language`` adds.
LANG, SCORE = "_lang_pred", "_lang_score"


def _judged(rows: DataFrame, position: int, kept: list[int], trained: Languages, block: int) -> DataFrame:
    """Rows c0, c1, ... with ``LANG`` and ``SCORE``, of the columns those kept."""
    width, spark = len(rows.columns), rows.sparkSession
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    state = {"lettered": "boolean", "lang": "string", "least": "double", "odds": "double"}
    made = rows.withColumn("lettered", has_letter(F.col(f"c{position}").cast("string")))
    parsers = trained.parsers()
    parser, first = next(parsers), True
    while parser is not None:
        later = next(parsers, None)
        shared = spark.sparkContext.broadcast(parser)
        columns = list(range(width)) if later is not None else kept

        def run(batches: Iterator[pa.RecordBatch], shared=shared, columns=columns, first=first) -> Iterator[pa.RecordBatch]:
            for batch in row_slices(batches, position, GROUP_CHARS):
                lang, least, odds = judge(batch.column(position).to_pylist(), batch.column(width).to_pylist(), shared.value, block)
                if not first:  # equal costs stay with the language of an earlier block
                    old, was, n = batch.column(width + 1).to_pylist(), *(batch.column(width + k).to_numpy() for k in (2, 3))
                    both = np.minimum(was, least)
                    with np.errstate(invalid="ignore"):  # of texts that are not judged
                        odds = np.where(np.isfinite(both), n * np.exp2(-np.minimum(was - both, 60)) + odds * np.exp2(-np.minimum(least - both, 60)), 0)
                    lang, least = [a if w <= x else b for a, b, w, x in zip(old, lang, was, least, strict=True)], both
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column(width), pa.array(lang, pa.string()), pa.array(least), pa.array(odds)], [*(f"c{c}" for c in columns), *state])

        made = made.mapInArrow(thrifty(run), ", ".join([*(f"c{c} {kinds[c]}" for c in columns), *(f"{n} {k}" for n, k in state.items())]))
        if later is not None:
            made = stored(made, "languages")
            shared.destroy()
        parser, first = later, False
    return made.select(*(f"c{c}" for c in kept), F.coalesce("lang", F.lit("und")).alias(LANG), F.when(F.col("lang").isNotNull(), 1 / F.col("odds")).otherwise(0.0).alias(SCORE))


def identify(docs: DataFrame, trained: Languages, *, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """id, lang_pred and score of every row."""
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("c1"))
    return _judged(rows, 1, [0], trained, block).toDF(id_col, "lang_pred", "score")


def with_language(docs: DataFrame, trained: Languages, *, text_col: str = "text", block: int = 512) -> DataFrame:
    """``docs`` with the language and its score as the last columns, ``LANG`` and ``SCORE``."""
    every = list(range(len(docs.columns)))
    return _judged(docs.toDF(*(f"c{k}" for k in every)), docs.columns.index(text_col), every, trained, block).toDF(*docs.columns, LANG, SCORE)


def keep_languages(docs: DataFrame, trained: Languages, languages: list[str] | None = None, *, min_score: float = 0.0, text_col: str = "text", block: int = 512) -> DataFrame:
    """The rows judged one of ``languages`` (None: any that was learnt) with at least ``min_score``, all columns as they are."""
    wanted = F.col(LANG).isin(languages if languages is not None else trained.langs or [""])
    return with_language(docs, trained, text_col=text_col, block=block).filter(wanted & (F.col(SCORE) >= min_score)).select(*docs.columns)
