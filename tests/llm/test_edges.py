"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from cuewright.llm import decontaminate, inner_product, language_id, license_scan, line_dedup, lm_score, merge_dropout, quality, simhash, url_filter
from cuewright.llm.queries import RULES, TOKENIZER, remainder

from . import brute

rng = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "ne", "so") for c in ("l", "n", "ten", "rik")]
LONG = " ".join(rng.choice(WORDS) for _ in range(60_000))
REPEATED = "a line that many of the documents repeat"
BENCH = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
TEXTS = [
    (1, f"{REPEATED}\nfirst own text of some words here"),
    (2, f"  {REPEATED.upper()}\t\nsecond own text with other words"),
    (3, f"{REPEATED}\r\nthird"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r"),
    (7, "\n\n\n"),
    (8, LONG),
    (9, LONG + f" {BENCH}"),
    (10, f"Before it: {BENCH.title()}. After."),
    (11, "▁ mark  and   spaces \x00 zero \U0001f600 face Ünïcode ſ İ"),
    (12, "single"),
    (13, "single"),
    (14, "12345 !!! ... 678"),
    (15, NOTICE := license_scan.NOTICES["MIT-grant"] + " and more words follow here"),
    (15, NOTICE),
    (15, "the same id with another text altogether"),
    (1, f"{REPEATED}\nfirst own text of some words here"),
    (None, f"{REPEATED}\nno id at all but words"),
    (None, None),
    (None, "single"),
    (16, BENCH.replace(" ", "\n")),
    (17, "é" * 30_000),
]
#: Columns whose names the operators use inside.
CLASH = "id key fp row h n k1 doc lettered learn _id _text _label component_id fingerprint n_lines n_dropped spans items _key _fp c0 c1 _dropped _bad_id score ids text_ m path".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, None, *("x" for _ in CLASH)) for i, t in TEXTS]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    return made.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BENCH), (2, None), (3, ""), (4, "single"), (1, BENCH), (None, "no item"), (5, "zeta eta theta")], "item_id long, text string")


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_license_scan(docs, empty):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(TEXTS)
    assert Counter(r.doc_id for r in rows if "MIT-grant" in [m.license for m in r.matches]) == {15: 2}
    assert all(not r.matches for r in rows if r.doc_id in (4, 5, 6, 7, 8, 17))
    assert license_scan.scan(empty).count() == 0
    assert all(not r.matches for r in license_scan.scan(docs, {}).collect())
    assert all(not r.matches for r in license_scan.scan(docs, {"nothing": "..."}).collect())


def test_license_scan_finds_short_wide_and_repeated_notices(spark):
    own = " ".join(f"n{k}" for k in range(29))
    wide = own.replace("n14 ", "n14 " + " ".join(f"in{k}" for k in range(12)) + " ")
    texts = [" ".join(f"x{k}" for k in range(pad)) + " " + wide for pad in range(60)] + ["Some words before. All rights reserved. And after", f"{own} between {own} {own}"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {"own": own, "short": "All rights reserved."}).collect()
    got = {r.doc_id: [(m.license, m.begin, m.end) for m in r.matches] for r in rows}
    assert all(got[pad] == [("own", pad, pad + 41)] for pad in range(60))
    assert got[60] == [("short", 3, 6)]
    assert got[61] == [("own", 0, 29), ("own", 30, 59), ("own", 59, 88)]
    assert "All-rights-reserved-line" in [m.license for m in license_scan.scan(spark.createDataFrame([(1, texts[60])], "doc_id long, text string")).first().matches]


def test_lm_score(docs, empty, spark):
    rows = lm_score.score(docs, ~(remainder(docs.doc_id, 7) == 2)).collect()
    assert len(rows) == len(TEXTS)
    assert Counter(r.n_tokens for r in rows) == Counter(len(brute.WORD.findall(t or "")) + 1 for _, t in TEXTS)
    assert all(r.score <= 0 and r.base_score < 0 for r in rows)
    assert lm_score.score(empty, empty.doc_id > 0).count() == 0
    unlearnt = lm_score.score(docs, docs.doc_id < 0).collect()  # only null ids are learnt from
    assert len({r.train_tokens for r in unlearnt}) == 1
    none = lm_score.score(docs.filter("doc_id > 0"), docs.doc_id < 0).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTPS://A.B.Example.COM/en/7x?q", "http://example.com/en/", "http://com/en/1", "x://y://z.org/es/", "http://notexample.com/en/", "http://example.com./en/", "http://.com/en/", "ftp://u@net/de/8#f"]
    pages = spark.createDataFrame([(k if k % 4 else None, u, "x") for k, u in enumerate(urls * 2)], "page_id long, url string, id string")
    rows = url_filter.judge(pages, RULES).collect()
    assert len(rows) == 2 * len(urls)
    got = {(r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert got["", ""] == (None, "allow")
    assert got["a.b.example.com", "/en/7x"] == ("example.com/en/7", "allow")
    assert got["example.com", "/en/"] == got["com", "/en/1"] == got["notexample.com", "/en/"] == ("com/en/", "block")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}


def test_url_rules_are_those_of_the_contract(spark):
    urls = {"http://net/de/1": ("net/de/", "allow"), "http://a.example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://b.example.net/de/80?q": ("example.net/de/8", "block"), "http://net/en/": (None, "allow"), "http://x.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(pages, RULES).join(pages, "page_id").collect()
    assert {r.url: (r.rule, r.verdict) for r in rows} == urls


def test_url_filter_of_many_blocks(spark):
    """A list of any length, very long URLs and equal rules: the same as one trie."""
    r = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "x.y", ""]
    rules = [url_filter.Rule(r.choice(["allow", "block"]), r.choice(hosts), r.choice(["", "/", "/p", "/p/", "/p/q", "/p/qr/s"])) for _ in range(60)]
    urls = [f"http://{h}{p}" for h in ("a", "b.a", "z.c.b.a", "x.y", "y", "q.x.y") for p in ("", "/", "/p", "/p/q", "/p/qrs", "/p/qr/s/t", "/p/" + "q/" * 40_000)] + ["http://" + "w." * 30_000 + "b.a/p/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    last = {(x.host, x.path): x for x in rules}
    for block_bytes in (1, 20_000, 1 << 20):
        for row in url_filter.judge(pages, rules, block_bytes=block_bytes).collect():
            fits = [x for x in last.values() if (not x.host or row.host == x.host or row.host.endswith("." + x.host)) and row.path.startswith(x.path)]
            best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
            assert (row.rule, row.verdict) == ((best.name, best.action) if best else (None, "allow"))


@pytest.mark.parametrize("dropout", [0.0, 0.3, 1.0])
def test_merge_dropout(docs, empty, dropout):
    model = merge_dropout.PieceModel(TOKENIZER)
    rows = merge_dropout.encode(docs, model, dropout=dropout).cache()
    assert all(r.lossless for r in rows.select("lossless").collect()) and rows.count() == len(TEXTS)
    back = merge_dropout.decode(rows, model)
    assert counted(back.collect()) == Counter((i, t or "") for i, t in TEXTS)
    again = merge_dropout.encode(docs.repartition(7), model, dropout=dropout)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in again.collect())
    assert merge_dropout.encode(empty, model).count() == 0 and merge_dropout.decode(rows.limit(0), model).count() == 0
    rows.unpersist()


def test_merge_dropout_varies_every_occurrence(spark):
    model = merge_dropout.PieceModel(TOKENIZER)
    word = " internationalization"
    r = merge_dropout.encode(spark.createDataFrame([(1, word * 2000)], "doc_id long, text string"), model, dropout=0.3).first()
    cuts, own = set(), []
    for i in r.ids:
        if own and model.out_bytes[model.out_at[i]] == 32:
            cuts.add(tuple(own))
            own = []
        own.append(i)
    assert r.lossless and len(cuts) > 50


def test_merge_dropout_without_dropout_is_the_tokenizer(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = ["single", "Ünïcode and some ordinary words, with marks.", "the 123 numbers", NOTICE, " ".join(WORDS)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in merge_dropout.encode(df, merge_dropout.PieceModel(TOKENIZER), dropout=0).collect():
        assert list(r.ids) == processor.encode(texts[r.doc_id])


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 17)] + [(1, 0, 0), (None, 1, 0), (3, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.train(docs, labels.limit(0)), quality.train(docs, labels.filter("quality = 1")), quality.train(empty, labels)):
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert quality.score(empty, model).count() == 0
    one, two = ({(r.doc_id, round(r.score, 9)) for r in quality.score(docs, quality.train(d, x)).collect()} for d, x in ((docs, labels), (docs.repartition(5), labels.repartition(2))))
    assert one == two


@pytest.mark.parametrize("block_words", [500_000, 1])
def test_decontaminate(docs, empty, bench, block_words):
    found = decontaminate.find_benchmark_text(docs, bench, block_words=block_words).collect()
    items = [(i, t) for i, t in ((1, BENCH), (4, "single"), (5, "zeta eta theta"))]
    want = Counter()
    for i, t in TEXTS:
        n, hit, n_items, sha, _ = brute.contamination([(0, t)], items)[0]
        want[i, n, hit, n_items, sha] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found)
    assert got == want
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in found)
    kept = decontaminate.drop_contaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    clean = Counter((i, t) for i, t in TEXTS if not brute.contamination([(0, t)], items)[0][4])
    assert counted(kept.select("doc_id", "text").collect()) == clean
    cut = decontaminate.cut_benchmark_text(docs, bench, block_words=block_words)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = Counter(r.text for r in cut.collect())
    assert texts["Before it: . After."] == 1 and texts[None] == 2 and texts[LONG + " "] == 1 and BENCH.replace(" ", "\n") not in texts
    for d, b in ((empty, bench), (docs, bench.limit(0)), (empty, bench.limit(0))):
        assert decontaminate.cut_benchmark_text(d, b).count() == d.count()
        assert all(r.n_hit == 0 for r in decontaminate.find_benchmark_text(d, b).collect())
        assert decontaminate.drop_contaminated(d, b).count() == d.count()


def test_words_of_an_item_without_id_are_hit(spark):
    docs = spark.createDataFrame([(1, "a few words of it")], "doc_id long, text string")
    row = decontaminate.find_benchmark_text(docs, spark.createDataFrame([(None, "few words")], "item_id long, text string")).first()
    assert (row.n_hit, row["items"], [tuple(s) for s in row.spans]) == (2, [], [(1, 3)])


def test_fm_index_finds_every_occurrence():
    import numpy as np

    from cuewright.llm.fm_index import FMIndex, from_bytes, to_bytes

    r = np.random.default_rng(4)
    for alphabet in (2, 5, 60):
        symbols = r.integers(0, alphabet, 3000)
        symbols[1000:1500] = symbols[:500]
        symbols[-1] = 0
        index = FMIndex.from_arrays(from_bytes(to_bytes(FMIndex.of(symbols, alphabet).arrays())))
        for length in (1, 3, 6):
            phrases = np.array([symbols[k : k + length] for k in range(2900) if (symbols[k : k + length] > 0).all()][:400]).reshape(-1, length)
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(symbols, length) == p).all(1))
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want.tolist()


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    want = Counter()
    held = {i for i, t in TEXTS if t and i is not None and REPEATED in t.lower()}
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i == max(held) or brute.line_key(x) != REPEATED]
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert counted(got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == want
    # one block of filters a shard
    assert counted(line_dedup.dedup_lines(docs, filter_bytes=0).select("doc_id", "text", "n_lines", "n_dropped").collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_store_is_reversible(docs, spark):
    store = line_dedup.LineStore(spark).insert(docs.filter("doc_id < 3")).insert(docs.filter("doc_id >= 3"))
    whole = counted(store.counts().collect())
    assert whole == counted(line_dedup.LineStore(spark).insert(docs).counts().collect())
    gone = spark.createDataFrame([(3,), (3,), (77,)], "doc_id long")
    store.delete(gone)
    assert store.repeated().count() == 0  # two documents hold the line now
    assert counted(store.counts().collect()) == counted(line_dedup.LineStore(spark).insert(docs.filter("doc_id <> 3")).counts().collect())
    again = line_dedup.LineStore(spark, store.root)  # as another session would open it
    assert again.version == 3
    again.insert(docs.filter("doc_id = 3"))
    assert counted(again.counts().collect()) == whole
    assert counted(again.apply(docs).collect()) == counted(line_dedup.dedup_lines(docs).collect())
    with pytest.raises(ValueError, match="settings"):
        line_dedup.LineStore(spark, store.root, min_docs=4)


def test_filters_follow_the_counts(spark):
    """Insertions that outgrow a filter and deletions: after each batch the filters hold the repeated keys, and few others."""
    import numpy as np

    from cuewright.llm.cuckoo import CuckooFilter

    line = "a line of its own, number {} of many".format
    docs = lambda ids, lines: spark.createDataFrame([(i, "\n".join(line(k) for k in lines)) for i in ids], "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=2)
    store.insert(docs([1, 2], range(40))).insert(docs([3], range(30))).insert(docs([4, 5, 6], range(20, 900)))
    store.delete(docs([4, 77], [1]))
    assert store.delete(docs([5, 6], [1])).version == 5
    for _ in range(2):
        keys = [r.k1 for r in store.repeated().collect()]
        every = [r.k1 for r in store.counts().collect()]
        held = {r.shard: CuckooFilter.from_bytes(bytes(r.filter)) for r in store.filters().collect()}
        inside = lambda k, held=held: k % 2 in held and bool(held[k % 2].contains(np.array([k], np.int64))[0])
        assert all(map(inside, keys)) and len(keys) == (30 if _ == 0 else 900)
        assert sum(map(inside, every)) <= len(keys) + 5
        store.insert(docs([7, 8, 9], range(900)))


def test_shards_follow_the_keys(spark, monkeypatch):
    """Filters are built anew with more shards once twice as many keys are held; an opened store goes on with them."""
    import numpy as np

    from cuewright.llm.cuckoo import CuckooFilter

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    line = "a line of its own, number {} of many".format
    docs = lambda ids, lines: spark.createDataFrame([(i, "\n".join(line(k) for k in lines)) for i in ids], "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=2).insert(docs([1, 2, 3], range(20)))
    assert (store.shards, store.n_repeated) == (3, 20)
    store.insert(docs([4, 5, 6], range(20, 25)))
    assert (store.shards, store.since, store.n_repeated) == (3, 1, 25)
    again = line_dedup.LineStore(spark, store.root, shards=2).insert(docs([7, 8, 9], range(25, 100)))
    assert (again.shards, again.since, again.n_repeated) == (13, 3, 100)
    again.delete(docs([7], [1]))
    opened = line_dedup.LineStore(spark, store.root)
    assert (opened.shards, opened.since, opened.n_repeated) == (13, 3, 25)
    held = {r.shard: CuckooFilter.from_bytes(bytes(r.filter)) for r in opened.filters().collect()}
    assert max(held) < 13 and all(held[r.k1 % 13].contains(np.array([r.k1], np.int64))[0] for r in opened.repeated().collect())
    with pytest.raises(RuntimeError, match="another writer"):  # it knows nothing of the last two batches
        store.insert(docs([10], range(3)))
    assert line_dedup.LineStore(spark, store.root).version == 4


def test_lines_are_found_by_passes_and_by_one_shuffle(spark, docs, monkeypatch):
    want = counted(line_dedup.dedup_lines(docs).collect())
    for most in (0, 1000):
        monkeypatch.setattr(line_dedup, "MOST_PASSES", most)
        assert counted(line_dedup.dedup_lines(docs, filter_bytes=0).collect()) == want


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("select cast(id as long) as doc_id, cast(unhex(concat('61207479706963616C206C696E6520FF20776974682062616420627974657320E2820A', hex(cast(id as string)), 'C3')) as string) as text from range(4)")
    kept = line_dedup.dedup_lines(docs).selectExpr("doc_id", "hex(text) as h", "n_dropped").collect()
    assert {(r.doc_id, r.n_dropped) for r in kept} == {(0, 1), (1, 1), (2, 1), (3, 0)}
    assert {r.h for r in kept if r.doc_id < 3} == {f"3{k}C3" for k in range(3)}
    model = merge_dropout.PieceModel(TOKENIZER)
    rows = merge_dropout.encode(docs, model).cache()
    assert all(r.lossless for r in rows.collect())
    back = merge_dropout.decode(rows, model).selectExpr("doc_id", "hex(text) as h")
    assert counted(back.collect()) == counted(docs.selectExpr("doc_id", "hex(text) as h").collect())


def test_language_id(docs, empty, spark):
    parser = language_id.train(docs)
    rows = language_id.identify(docs, parser).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6, 7, 14, None}
    assert sum(r.lang_pred == "und" for r in rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert counted(language_id.keep_languages(docs, parser).select("doc_id", "text").collect()) == Counter((i, t) for i, t in TEXTS if t and any(c.isalpha() for c in t))
    untrained = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(docs, untrained).collect()} == {"und"}
    assert language_id.identify(empty, parser).count() == 0 and language_id.keep_languages(empty, parser).columns == docs.columns


def test_inner_product(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf]), (None, [9.0, 9.0]), (7, []), (50, [-0.5, -0.25]), (50, [-0.5, -0.25]), (100, [0.001, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in vectors], "vec_id long, embedding array<float>, label int, id string, v string")
    rows = inner_product.top_k(df, inner_product.F.col("id") % 50 == 0).collect()
    held = [(i, [int(256 * x // 1) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and x == x and abs(x) != inf for x in v)]
    want = Counter()
    for q in (0, 50, 100):  # rows of one id are candidates each, and share the id's places as queries
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for j, x in held if j == q for i, y in held if i != q)[:5]
        want |= Counter({(q, rank, i, -s): 1 for rank, (s, i) in enumerate(best, 1)})
    assert counted(rows) == want
    assert inner_product.top_k(df.limit(0), inner_product.F.col("id") % 50 == 0).count() == 0


def test_inner_product_of_large_numbers(spark):
    """Components beyond 2**31 are exact; scores that no long can hold end the query."""
    vectors = [(0, [2.0**40, 1.0]), (1, [2.0**6, 1 / 256]), (2, [2.0**6, 3 / 256]), (3, [-1.0, 0.5]), (50, [3.0, 2.0**45]), (4, [0.0, 2.0**-8])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    held = {i: [int(256 * x // 1) for x in v] for i, v in vectors}
    want = {}
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q)[:3]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    rows = inner_product.top_k(df, inner_product.F.col("id") % 50 == 0, k=3).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows} == want
    beyond = df.unionByName(spark.createDataFrame([(5, [2.0**50, 0.0])], df.schema))
    with pytest.raises(Exception, match="beyond a long"):
        inner_product.top_k(beyond, inner_product.F.col("id") % 50 == 0, k=3).collect()


def test_inner_product_prunes_exactly(spark):
    """Long and short, clustered and opposite vectors with tiny buckets and blocks against brute force."""
    import numpy as np

    r = np.random.default_rng(3)
    m = r.normal(size=(700, 12)) * r.lognormal(0, 1.5, size=(700, 1))
    m[::7] = m[0] * r.uniform(0.5, 2, size=(100, 1))
    m[5::9, 3] += 40
    df = spark.createDataFrame([(k, x) for k, x in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    q = np.floor(m * 256).astype(np.int64)
    want = {(i, rank): (j, s) for i in range(0, 700, 50) for rank, (s, j) in enumerate([(-a, b) for a, b in sorted((-int(x), k) for k, x in enumerate(q @ q[i]) if k != i)[:5]], 1)}
    for kw in ({"probe": 8, "bucket": 16, "block_bytes": 400}, {}):
        rows = inner_product.top_k(df, inner_product.F.col("id") % 50 == 0, **kw).collect()
        assert {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in rows} == want


def test_simhash(docs, empty):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(TEXTS)
    prints = [(i, brute.fingerprint(t)) for i, t in TEXTS]
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((i, f"{f:016x}") for i, f in prints)
    of = {r.fingerprint: r.component_id for r in rows}
    assert of["0" * 16] == 4 and of[f"{brute.fingerprint('single'):016x}"] == 12 and of[f"{brute.fingerprint(LONG):016x}"] == 8
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and ids[4] == ids[8] == ids[12] == 1 and not {5, 6, 7, 13} & set(ids)
    assert simhash.components(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0
    nameless = docs.filter("doc_id is null")
    assert simhash.keep_one_of_each(nameless).count() == 3


def test_simhash_splits_large_groups(spark, monkeypatch):
    """Keys shared by more classes than the limit: the same components as brute force."""
    import numpy as np

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:12]:
        for _ in range(40):
            x = b
            for k in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << k
            fps.add(x)
    fps |= {(1 << 20) * k for k in range(300)}  # one key for many
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from cuewright.llm.components import connected

    numbers = brute.simhash_components(dict(enumerate(fps)))
    want = {f: numbers[k] for k, f in enumerate(fps)}
    for limit, held in ((2000, 1 << 16), (5, 50)):
        monkeypatch.setattr(simhash, "HELD_ROWS", held)
        monkeypatch.setattr(simhash, "HELD_PAIRS", held)
        got = {x.node: x.root for x in connected(simhash.links(classes, group_limit=limit)).collect()}
        mine = {f: got.get(s, s) for f, s in zip(sorted(fps), signed, strict=True)}
        by_mine, by_want = {}, {}
        for f in fps:
            by_mine.setdefault(mine[f], set()).add(f)
            by_want.setdefault(want[f], set()).add(f)
        assert set(map(frozenset, by_mine.values())) == set(map(frozenset, by_want.values()))


def test_pipeline_stages(docs, empty, bench, spark, tmp_path):
    own = docs.select(*corpus_pipeline.COLUMNS)
    own.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (own, own.limit(0)):
        now = source
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "pieces":
                assert set(now.columns) == set(corpus_pipeline.COLUMNS)
                now.write.parquet(path := f"{tmp_path}/{name}-{source.count()}")
                now = spark.read.parquet(path)
        assert now.count() <= source.count()
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() < len(TEXTS)
    assert Path(tmp_path, "documents.parquet").exists()
