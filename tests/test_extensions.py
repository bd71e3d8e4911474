"""Converters chosen by a registry, and cuts by learnt word costs."""

import itertools

import pytest
from pyspark.sql import functions as F

from cuewright.functions import repair
from cuewright.operators import converters

RANKED = "the a going home we are in to delicious book that was super hero man heroman".split()
LEXICON = repair.Lexicon(frozenset(), frozenset(), frozenset(), repair.word_costs(RANKED))


def every_cut(word):
    """All cuts into known words, by brute force."""
    for n in range(len(word)):
        for places in itertools.combinations(range(1, len(word)), n):
            cut = [word[a:b] for a, b in itertools.pairwise([0, *places, len(word)])]
            if all(p in LEXICON.costs for p in cut):
                yield sum(LEXICON.costs[p] for p in cut), cut


@pytest.mark.parametrize("word", ["wearegoing", "superheroman", "thatwasa", "inathe", "xyz", "a", "thehomea", "heroman"])
def test_cheapest_cut_is_the_cheapest_of_all(word):
    got, every = repair.cheapest_cut(word, LEXICON.costs), sorted(every_cut(word))
    assert (got is None) == (not every)
    assert got is None or sum(LEXICON.costs[p] for p in got) == every[0][0]


def test_words_longer_than_the_ends_are_cut_out():
    long_, longer = "wordy" * 6, "long" * 20
    costs = repair.word_costs(["a", "be", long_, longer, "wordywordy"])
    for word in (f"a{long_}be", f"{longer}{long_}", f"be{longer}a{longer}", f"x{longer}", "wordywordya"):
        own = [w for w in itertools.product(["", *costs], repeat=4) if "".join(w) == word]
        want = min((sum(costs[p] for p in w if p) for w in own), default=None)
        got = repair.cheapest_cut(word, dict(costs))
        assert (got and (sum(costs[p] for p in got), "".join(got))) == (want and (want, word))


def test_words_of_long_texts_are_glued_in_one_search(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    long_ = [words[k * k % 64] for k in range(20_001)]
    docs = spark.createDataFrame([(" ".join(long_),), ("one",), ("",), (None,), ("a-b c",)], "text string")
    got = [r.token for r in repair.glued(docs, "[a-z]+").collect()]
    assert sorted(got) == sorted([*map("".join, itertools.batched(long_, 2)), "one", "ab", "c"])
    plan = repair.glued(docs, "[a-z]+")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a search within the pairs' lambda would run once a pair


def test_guards_of_probable_cuts():
    known = repair.Lexicon(frozenset(), frozenset(), frozenset(), repair.word_costs([*RANKED, "xq", "ca", "bat", "ran", "far", "off"]))
    cut = lambda w: repair.split_probable(w, known)
    assert cut("WeAreGoing") == ["We", "Are", "Going"]
    assert cut("wearego") is None  # under eight letters
    assert cut("homexqhome") is None  # xq is no common short word
    assert cut("superahome") is None and cut("bookahome") == ["book", "a", "home"]
    assert cut("Batranfaroff") is None and cut("batranfaroff") == ["bat", "ran", "far", "off"]
    assert cut("weareintoatoin") is None  # seven pieces of two letters
    assert cut("homezzzhome") is None and cut("héroman-home") is None


def test_the_gate(spark):
    words = frozenset({"deliciousness", "yes"})
    lexicon = repair.Lexicon(words, frozenset(), frozenset(), repair.word_costs([*RANKED, "ness"]))
    assert repair.split_word("wearegoinghome", lexicon) == "wearegoinghome"
    assert repair.split_word("wearegoinghome", lexicon, probable=True) == "we are going home"
    long_ = repair.Lexicon(words, frozenset(), frozenset(), repair.word_costs(["yes", "delicious", "ness", "home"]))
    assert repair.split_word("yesdeliciousness", long_) == "yes deliciousness"
    assert repair.split_word("yesdeliciousness", long_, probable=True) == "yes delicious ness"  # thirteen letters may be glued still
    title = repair.Lexicon(frozenset(), frozenset({"za", "ar", "ro"}), frozenset({"zar", "aro"}), repair.word_costs(RANKED))
    assert repair.split_word("Zarozthatwashome", title, probable=True) == "Zaroz that was home"
    shared = spark.sparkContext.broadcast(lexicon)
    row = spark.range(1).select(*(repair.postprocess(shared, F.lit("wearegoinghome now"), F.lit("eng"), probable).alias(str(probable)) for probable in (False, True))).first()
    assert row["False"] == "wearegoinghome now" and row["True"] == "we are going home now"


def test_costs_are_learnt_by_rank(spark):
    docs = spark.createDataFrame([("b b b b a a a c c c d d",)], "text string")
    assert list(repair.learn(docs).costs) == ["b", "a", "c"]
    assert repair.word_costs([]) == {}


def test_table_function(spark):
    @converters.converter("own")
    class Own:
        def extract(self, content, language):
            if b"x" in content:
                raise ValueError("x")
            return [converters.Line(content.decode(), 1, 2, 3, 4)]

    own = spark.createDataFrame([(1, "own", "en", bytearray(b"ok")), (2, "own", "en", bytearray(b"x"))], "image_id long, converter string, language string, content binary")
    assert sorted(tuple(r) for r in converters.converted(own).drop("converter").collect()) == [(1, 0, "ok", 1, 2, 3, 4, None), (2, None, None, None, None, None, None, "ValueError")]
    rows = [("a", "lines", b" one \n\n two"), ("b", "whole", b" one \n two "), ("c", "whole", b"  "), ("d", "none", b"z"), ("e", "lines", None), ("f", "lines", b"\xff"), ("g", None, b"q")]
    images = spark.createDataFrame([(i, c, "en", t and bytearray(t)) for i, c, t in rows], "image_id string, converter string, language string, content binary")
    got = {(r.image_id, r.line): (r.text, r.error) for r in converters.converted(images, parts=3).collect()}
    assert got == {("a", 0): ("one", None), ("a", 1): ("two", None), ("b", 0): ("one \n two", None), ("d", None): (None, "there is no converter none"), ("f", None): (None, "UnicodeDecodeError"), ("g", None): (None, "there is no converter None")}
    assert converters.converted(images.limit(0)).count() == 0
    images.withColumn("part", F.lit(0)).createOrReplaceTempView("own_images")
    converters.register(spark)
    assert spark.sql("SELECT count(*) FROM convert_images(TABLE(own_images))").first()[0] == 6
    with pytest.raises(Exception, match="lack part"):
        spark.sql("SELECT * FROM convert_images(TABLE(SELECT 1 AS image_id, 'x' AS converter, 'en' AS language, X'00' AS content))").collect()


def test_registry(spark):
    files = spark.createDataFrame([("own", "AA"), ("common", "bb"), ("given", "cc")], "name string, sha256 string")
    rows = [
        ("first", 0, "c", "own", " aa", None), ("first", 1, "d", "common", "bb", None), ("second", 0, "c", "gone", "x", None), ("second", 1, "d", "common", "zz", None),
        ("given", 0, "c", "own", "aa", None), ("given", 1, "d", "common", "bb", "given"), ("lost", 0, "c", "own", "aa", "nowhere"), ("none", 0, "c", "gone", "x", None), ("blank", 0, "c", "own", None, None),
    ]
    registry = spark.createDataFrame(rows, "profile string, ord int, converter string, file string, sha256 string, override string")
    got = {r.profile: tuple(r)[1:] for r in converters.resolve(registry, files).collect()}
    assert got == {
        "first": ("c", "own", "candidate", "ok"), "second": ("d", "common", "candidate", "mismatch"), "given": ("d", "given", "override", "unchecked"),
        "lost": (None, "nowhere", "override", "error"), "none": (None, None, "none", "missing"), "blank": ("c", "own", "candidate", "mismatch"),
    }
