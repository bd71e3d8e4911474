"""Operators without an SQL form against plain versions, on the driver's small tables."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import language_id, license_scan, lm_score, merge_dropout, quality, queries

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_inner_product(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    m = np.array([np.floor(np.array(e, np.float64) * 256) for _, e in rows]).astype(np.int64)
    want = {}
    for i, q in zip(ids.tolist(), m, strict=True):
        if i % 50 == 0:
            order = sorted((-int(s), int(j)) for j, s in zip(ids, m @ q, strict=True) if j != i)[:5]
            want |= {(i, rank): (j, -s) for rank, (s, j) in enumerate(order, 1)}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op9_inner_product(spark, SF).collect()} == want


def test_url_filter(spark):
    for r in queries.op3_url_filter(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (brute.lower(m[1]), m[2]) if m else ("", "")
        fits = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, best.action if best else "allow")


def plain_model(docs, learn, min_count=2):
    rows = [(d, [*brute.WORD.findall(brute.lower(t or "")), None]) for d, t in docs]
    texts = dict(rows)
    uni, bi, n_texts = Counter(), Counter(), 0
    for d, w in rows:
        if learn(d):
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
            n_texts += 1
    total, distinct = sum(uni.values()), len(uni)
    kept = {k: c for k, c in bi.items() if c >= min_count}
    times = uni | {"<s>": n_texts}
    left = defaultdict(lambda: 1.0)
    for (a, _), c in kept.items():
        left[a] -= (c - lm_score.DISCOUNT) / times[a]
    p = lambda w: (uni[w] + 1) / (total + distinct + 1)
    out = {}
    for d, w in texts.items():
        base = sum(math.log10(p(x)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w], w, strict=False):
            own = left[a] * p(b)
            score += math.log10(own + (kept[a, b] - lm_score.DISCOUNT) / times[a] if (a, b) in kept else own)
        out[d] = (len(w), sum(uni[x] > 0 for x in w), total, base, score)
    return out


def test_lm_score(spark):
    import zlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_model(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    rows = queries.op2_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(r.score - score) < 0.002 * n  # stored probabilities have 16 bits
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize(("words", "entries", "block_bytes"), [(1 << 21, 1 << 25, 20_000), (40, 1 << 25, 1 << 20), (300, 200, 3_000)])
def test_lm_score_beyond_each_bound(spark, monkeypatch, words, entries, block_bytes):
    """Several blocks, few listed words, few trie entries: every count is looked up all the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    docs = docs.unionByName(docs.limit(3))  # repeated rows
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_model(plain, lambda d: d % 7 != 2)
    monkeypatch.setattr(lm_score, "WORDS", words)
    monkeypatch.setattr(lm_score, "ENTRIES", entries)
    monkeypatch.setattr(lm_score, "SHARD_ENTRIES", 200)
    monkeypatch.setattr(lm_score, "HELD_BIGRAMS", 500)
    rows = lm_score.score(docs, queries.F.col("doc_id") % 7 != 2, block_bytes=block_bytes).collect()
    assert len(rows) == 63
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - score) < 0.002 * n


def test_license_scan(spark):
    notices, n = license_scan.NOTICES, 5
    shingles = lambda w: {tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)} if w else set()
    sets = {k: shingles(brute.item_words(t)) for k, t in notices.items()}
    rows = queries.op1_license_scan(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    n_found = 0
    for r in rows:
        w = brute.item_words(r.text)
        got = {m.license for m in r.matches}
        whole = {k for k, s in sets.items() if s and s <= shingles(w) and " ".join(brute.item_words(notices[k])) in " ".join(w)}
        assert whole <= got
        for m in r.matches:
            inside = shingles(w[m.begin : m.end])
            assert len(inside & sets[m.license]) >= 0.8 * len(sets[m.license])
        n_found += len(got)
    assert n_found > 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.9 * len(out)


def plain_phrases(parser, lang, train_text, text):
    """Greedy longest matches in the training symbols, one symbol where none matches."""
    learnt = "".join(map(chr, np.concatenate([parser.symbols(t) for t in train_text])[: language_id.TRAIN_CHARS].tolist()))
    own = "".join(map(chr, parser.symbols(text).tolist()))
    at = n = 0
    while at < len(own):
        size = 1
        while at + size < len(own) and own[at : at + size + 1] in learnt:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("block", [7, 50, 512])
@pytest.mark.parametrize("alphabet", [3, 62])
def test_cross_parsing_is_that_of_whole_texts(spark, block, alphabet):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").limit(80).collect()
    texts = {}
    for r in rows[:24]:
        texts.setdefault(r.lang, []).append(r.text[:1500])
    texts["zh"] = ["\u6f22\u5b57\u4ec0\u4e48\u6f22\u5b57\u597d" * 5, "\u0939\u093f\u0928\u094d\u0926\u0940 \u0939\u093f"]
    parser = language_id.CrossParser(texts, alphabet=alphabet)
    samples = [r.text[:900] for r in rows[20:40]] + ["", "a", "\u6f22\u5b57\u4ec0\u4e48 \u597d\u6f22 ok", "zz" * 40, texts["zh"][0] + texts["zh"][1], " ".join(texts[parser.langs[0]])]
    got = parser.phrases([parser.symbols(t) for t in samples], block)
    for k, lang in enumerate(parser.langs):
        assert got[:, k].tolist() == [plain_phrases(parser, lang, texts[lang], t) for t in samples]


def test_language_ties_go_to_the_first_name():
    parser = language_id.CrossParser({"bb": ["same text here"], "aa": ["same text here"]})
    assert language_id.judge(["text here", None, "..."], [True, False, False], parser, 512)[0] == ["aa", None, None]


def plain_languages(texts, texts_of_docs):
    """Language and score of each text, by plain phrases of every language."""
    points = language_id.common_letters(texts, language_id.ALPHABET)
    out = []
    for text in texts_of_docs:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        costs = []
        for lang in sorted(texts):
            parser = language_id.CrossParser({lang: texts[lang]}, points=points)
            costs.append((plain_phrases(parser, lang, texts[lang], text) * parser.bits[0], lang))
        least, best = min(costs)
        out.append((best, 1 / sum(2 ** -(c - least) for c, _ in costs)))
    return out


@pytest.mark.parametrize("sent_bytes, wide", [(1, 2**31), (400_000, 2**31), (128 << 20, 2**31), (1, 1)])
def test_languages_in_blocks_equal_plain_parses(spark, monkeypatch, sent_bytes, wide):
    """Fifteen languages, one of which repeats another, in blocks of one, of some and of all; places in 32 and 64 bits."""
    monkeypatch.setattr(language_id, "WIDE", wide)
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").orderBy("doc_id").limit(60).collect()
    texts = {f"l{k % 14:02}": [] for k in range(14)}
    for k, r in enumerate(rows[:42]):
        texts[f"l{k % 14:02}"].append(r.text[:700])
    texts["l99"] = list(texts["l03"])
    samples = [r.text[:500] for r in rows[20:50]] + [None, "", "...", "a", texts["l03"][0], "\u6f22\u5b57"]
    trained = language_id.Languages(texts, sent_bytes=sent_bytes)
    assert len(list(trained.parsers())) == {1: 15, 128 << 20: 1}.get(sent_bytes, len(list(trained.parsers())))
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs, trained, block=64).collect()}
    assert got == {k: (lang, round(score, 9)) for k, (lang, score) in enumerate(plain_languages(texts, samples))}
    judged = language_id.with_language(docs.withColumn("lettered", F.lit("x")), trained)
    assert judged.columns == ["doc_id", "text", "lettered", language_id.LANG, language_id.SCORE] and judged.count() == len(samples)


def plain_agenda(model, text, key, dropout):
    """One part's merges in order of score and place; a skipped candidate is never asked again."""
    symbols = [(int(s), k, k + 1) for k, s in enumerate(model.symbols_of(np.array([ord(c) for c in text], np.int64)))]
    skipped = set()
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, begin, middle), (b, _, end) = symbols[k : k + 2]
            to = model.pairs.get((a, b))
            if to is None or (begin, middle, end) in skipped:
                continue
            if merge_dropout._skipped(np.array([key], np.uint64), *(np.array([x]) for x in (begin, middle, end)), dropout)[0]:
                skipped.add((begin, middle, end))
            elif best is None or model.rank[to] < best[0]:
                best = int(model.rank[to]), k, to
        if best is None:
            return [s for s, _, _ in symbols]
        _, k, to = best
        symbols[k : k + 2] = [(to, symbols[k][1], symbols[k + 1][2])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_merge_dropout_is_that_of_a_plain_agenda(dropout):
    model = merge_dropout.PieceModel(queries.TOKENIZER)
    parts = [" international", " segmentation", " aaaaaaaaaaaa", " straße", " x", " internationalisation", " unbelievably"]
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want = [plain_agenda(model, p, int(k), dropout) for p, k in zip(parts, keys, strict=True)]
    long_ = [merge_dropout.merge_long(model, model.symbols_of(np.array([ord(c) for c in p], np.int64)).tolist(), int(k), dropout) for p, k in zip(parts, keys, strict=True)]
    assert long_ == want
    symbols = np.concatenate([model.symbols_of(np.array([ord(c) for c in p], np.int64)) for p in parts])
    out, owner = merge_dropout.merge_short(model, symbols, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), keys, dropout)
    assert [out[owner == k].tolist() for k in range(len(parts))] == want


def test_quality_rules_are_what_their_text_says(spark):
    """The compiled expression against the rules applied one by one in plain Python."""
    sf = SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    assert model.weighted
    named = quality.statistics(queries.F.col("text"))
    rows = docs.select("doc_id", *(c.alias(n) for n, c in named.items())).collect()
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in rows:
        total = model.intercept + sum(w for w, rule in model.weighted if all(above < r[n] <= upto for n, above, upto in rule.bounds))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9


def test_license_recall_of_changed_notices(spark):
    """Notices with words dropped, changed and inserted: found wherever a stretch of the text holds enough of them."""
    import random

    rng = random.Random(11)
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    rows, wanted = [], []
    for name, text in license_scan.NOTICES.items():
        words_ = brute.item_words(text)
        k = min(5, len(words_))
        for _ in range(12):
            own = list(words_)
            for _ in range(max(1, len(own) // 60) * rng.randint(0, 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(99)}"] * rng.randint(0, 2)
            before, after = ([f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300))] for _ in range(2))
            share = len(shingles(own, k) & shingles(words_, k)) / len(shingles(words_, k))
            if share >= 0.8:
                wanted.append((len(rows), name))
            rows.append((len(rows), " ".join([*before, *own, *after])))
    found = {(r.doc_id, m.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for m in r.matches}
    assert len(wanted) > 200
    assert sum(x in found for x in wanted) >= 0.995 * len(wanted)
