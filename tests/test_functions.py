"""Column expressions on literal rows."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cuewright.functions import media as M
from cuewright.functions import recognition as Q
from cuewright.functions import releases as R
from cuewright.functions import repair
from cuewright.functions import text as T
from cuewright.operators import evaluation, hardware, routing


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.v for r in df.select("k", expression(F.col("x")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("expression", "pairs"),
    [
        (T.language_tag, {"en-US": "eng", " FRE ": "fra", "und": None, "unknown": None, "": None, "xx_YY": "xx", None: None, "nb": "nor", "English": "eng", "GERMAN": "deu", "Und": None, "\u00a0Ja_x": "jpn"}),
        (T.recogniser_language, {"zh-Hant": "chi_sim", "en": "eng", "": None, "dut": "nld", "qq": "qq"}),
        (T.script_subtag, {"sr-Latn-RS": "latn", "en": None, "zh_Hans": "hans"}),
        (T.normalise_lines, {"a \r\n\n  b": "a\nb", "": "", None: None}),
        (T.file_name_part, {'a/b:c*': "a-b-c-", "..": "unknown", " . x. ": "x", "": "unknown"}),
        (T.sidecar_language, {"EN us!": "enus", "??": "und", None: "und"}),
        (T.percent_encode, {"a b*~/é": "a%20b%2A~%2F%C3%A9"}),
        (lambda c: T.quality_label(c, F.lit(720)), {"F.1080p.x": "F.720p.x", "F.480p": "F.480p", "1080p.2160P": "1080p.720p", "x1080p": "x1080p", "F": "F"}),
        (T.strip_font_tags, {"<FONT color='a'>x</font><b>": "x<b>", "<font": "<font", "< font>y": "y"}),
        (T.strip_font_overrides, {r"{\fs20\b1\fnArial\i1}x": r"{\b1\i1}x", r"{\fscx50}": "{}"}),
        (T.ass_text, {r"0,0,,{\i1}Hi\Nyou": "Hi\nyou"}),
        (T.ass_escape, {"a\\{b}\nc\r": r"a\\\{b\}\Nc"}),
        (T.space_after_punctuation, {"a,b.c": "a, b. c", "1.5": "1.5"}),
        (T.space_letters_digits, {"ab12cd": "ab 12 cd", "21st": "21st", "3x": "3 x", "2ndly": "2 ndly"}),
        (T.space_before_quote, {'say"hi': 'say "hi'}),
        (T.evaluation_text, {" “a”  b… ": '"a" b...'}),
        (T.bits_per_second, {"1.5M": 1500000, "320 kbps": 320000, "1,000": 1000, "8mbit": 8000000, "x": None, "0": None, "5q": None, "8M/s": 8000000}),
        (T.boolish, {"Yes": True, "0": False, "maybe": None}),
        (T.fnv1a, {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}),
        (lambda c: T.with_suffix(c, F.lit("fixed")), {"/a/b.mkv": "/a/b.fixed.mkv", "/a.b/c": "/a.b/c.fixed"}),
        (lambda c: T.system_language(c), {"de_DE.UTF-8@euro": "de_DE", " ": None}),
        (R.numeric_range, {"01-02": True, "2024-01": False, "2024-01-02": True, "1234-5": False, "a-1": False, None: False}),
        (R.day_number, {"1970-01-02T00:00": 1, "2024-13-01": None, None: None}),
        (R.is_torrent, {"Torrent": True, "2": True, "usenet": False, None: False}),
        (routing.profile, {"en": "english", "ja": "japanese", "sr-Cyrl": "multilingual", "ru": "multilingual", "xx": "latin", "zh": "cjk", "xx-Zzzz": "english"}),
    ],
)
def test_text(spark, expression, pairs):
    assert values(spark, list(pairs), "string", expression) == list(pairs.values())


def test_lists(spark):
    assert values(spark, ["English / jpn, und;en"], "string", T.language_list) == [["eng", "jpn"]]
    assert values(spark, ["a=b, c = d ,x,=y,a=z"], "string", T.pairs) == [{"a": "b", "c": "d"}]
    assert values(spark, ["3, x,1,3"], "string", T.device_ids) == [[1, 3]]
    assert values(spark, ["x", "1|2;q 3"], "string", lambda c: T.env_ids(c)) == [[], [1, 2, 3]]


@pytest.mark.parametrize(("w", "h", "cap", "want"), [(641, 361, (1920, 1080), (640, 360)), (1920, 1080, (1280, 720), (1280, 720)), (0, 5, (10, 10), (1, 5)), (3, 3, (1280, 720), (2, 2)), (1998, 1080, (1280, 720), (1280, 692))])
def test_clamped_size(spark, w, h, cap, want):
    r = spark.range(1).select(M.clamped_size(F.lit(w), F.lit(h), F.lit(cap[0]), F.lit(cap[1])).alias("s")).first().s
    assert (r.width, r.height) == want


def test_presets(spark):
    assert values(spark, [0, 112_000, 1_000_000], "bigint", M.audio_preset) == ["192k", "96k", "320k"]
    assert values(spark, [40, 41, 43], "int", M.level_name) == ["4", "4.1", None]
    row = spark.range(1).select(M.target_bitrate(F.lit(5), F.lit(3)).alias("a"), M.target_bitrate(F.lit(0), F.lit(3)).alias("b"), M.target_bitrate(F.lit(5), F.lit(None).cast("int")).alias("c"), M.target_bitrate(F.lit(0), F.lit(None).cast("int")).alias("d")).first()
    assert tuple(row) == (3, 3, 5, None)


def release(**own):
    base = dict(title="A", protocol="usenet", languages=[], subtitle_languages=[], custom_formats=[], custom_format_score=0, quality_weight=0, rejected=False, rejections=None, download_allowed=None, release_type=None, mapped_ids=None, episode_ids=None, episode_id=None, episode_numbers=None, absolute_numbers=None)
    return base | own


RELEASE = "title string, protocol string, languages array<string>, subtitle_languages array<string>, custom_formats array<string>, custom_format_score bigint, quality_weight bigint, rejected boolean, rejections array<string>, download_allowed boolean, release_type string, mapped_ids array<bigint>, episode_ids array<bigint>, episode_id bigint, episode_numbers array<bigint>, absolute_numbers array<bigint>"


def judged(spark, rows, expression):
    df = spark.createDataFrame([Row(**r) for r in rows], RELEASE).select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("k"))
    return [x.v for x in df.select("k", expression(F.col("r")).alias("v")).orderBy("k").collect()]


def test_target_match(spark):
    rows = [release(release_type="seasonPack"), release(mapped_ids=[7]), release(mapped_ids=[7, 8]), release(mapped_ids=[], episode_ids=[7]), release(episode_ids=[8]), release(episode_id=7), release(episode_numbers=[1, 2]), release(title="E01-02"), release()]
    assert judged(spark, rows, lambda r: R.matches_episode(r, F.lit(7))) == [False, True, False, True, False, True, False, False, True]


def test_language_policies(spark):
    rows = [release(languages=["eng"]), release(languages=["eng"], custom_formats=["English Dub"]), release(title="Show.Dual-Audio"), release(title="x eng")]
    passes = {p: judged(spark, rows, lambda r, p=p: R.satisfies(r, ["eng"], [], p)) for p in R.POLICIES}
    assert passes == {"strict": [True, True, False, False], "custom-format": [False, True, False, False], "custom-format-or-title": [False, True, True, False], "title-guess": [False, True, True, True]}


def test_upgrade_candidates(spark):
    rows = [release(download_allowed=False), release(), release(rejected=True), release(rejected=True, rejections=["Existing file meets cutoff"]), release(rejected=True, rejections=["meets cutoff", "bad"]), release(rejected=True, rejections=[])]
    assert judged(spark, rows, lambda r: R.can_upgrade(r["download_allowed"], r["rejected"], r["rejections"])) == [False, True, False, True, False, False]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance(spark):
    import random

    rng = random.Random(3)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(60)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = [r.d for r in df.select("k", evaluation.edit_distance(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()]
    assert got == [plain_distance(a, b) for a, b in pairs]


def test_error_rates(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a"], ["a", "b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(evaluation.error_rate(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 2.0]


def test_quality_score(spark):
    score = lambda c: F.round(Q.quality_score(c, F.lit(True)), 4)
    got = dict(zip(["", "Hello there my friend.", "a|b @& c", "loremipsumdolorsit", "¤¤¤¤"], values(spark, ["", "Hello there my friend.", "a|b @& c", "loremipsumdolorsit", "¤¤¤¤"], "string", score), strict=True))
    assert got[""] == 0.0
    assert got["Hello there my friend."] == 1.0
    assert got["a|b @& c"] < got["Hello there my friend."]
    assert got["loremipsumdolorsit"] < 0.6
    assert got["¤¤¤¤"] == 0.0


LINE = "array<struct<text:string,bbox:struct<left:int,top:int,right:int,bottom:int>,score:float>>"


def test_lines(spark):
    box = lambda a, b, c, d: Row(left=a, top=b, right=c, bottom=d)
    rows = [[Row(text="one two", bbox=box(0, 0, 10, 2), score=0.5), Row(text="x", bbox=None, score=1.0)], [Row(text="averylonggluedsubtitle", bbox=None, score=None)], []]
    assert [None if v is None else round(v, 4) for v in values(spark, rows, LINE, Q.confidence)] == [round((0.5 * 20 + 1.0) / 21, 4), None, None]
    assert values(spark, rows, LINE, Q.spacing_fallback) == [False, True, False]
    assert values(spark, [[Row(text="tall", bbox=box(0, 0, 1, 9), score=1.0), Row(text="ok", bbox=None, score=1.0)]], LINE, lambda c: Q.pruned(c, F.lit("eng"))["dropped"]) == [1]
    assert values(spark, rows[:1], LINE, Q.joined_lines) == ["one two x"]


def test_likelihood_agrees_with_the_lexicon(spark):
    pairs, triples = ["th", "he", "in"], ["the", "ing"]
    lexicon = repair.Lexicon(frozenset(), frozenset(pairs), frozenset(triples))
    tokens = ["the", "thing", "zzzz", "a", "it's", "x1y", ""]
    got = values(spark, tokens, "string", lambda c: Q.likelihood(c, pairs, triples))
    assert [round(v, 9) for v in got] == [round(lexicon.likelihood(t), 9) for t in tokens]


def test_repair(spark):
    corpus = spark.createDataFrame([("where are you going today my friend he was there every day i think that we can stay listen to the music they said",)] * 4, "text string")
    lexicon = repair.learn(corpus)
    assert repair.split_known("whereareyou", lexicon) == ["where", "are", "you"]
    assert repair.split_known("going", lexicon) is None
    assert repair.split_word("thinkThat", lexicon) == "think That"
    assert repair.corrected("evert", lexicon) == "evert"
    assert repair.corrected("tofay", lexicon) == "tofay"
    shared = spark.sparkContext.broadcast(lexicon)
    got = values(spark, ["whereareyou going,my friend", None, ""], "string", lambda c: repair.postprocess(shared, c, F.lit("en")))
    assert got == ["where are you going, my friend", None, ""]
    assert values(spark, ["whereareyou"], "string", lambda c: repair.postprocess(shared, c, F.lit("fra"))) == ["whereareyou"]
    assert values(spark, ["l0ve th1s", "l2th", "vvhat", "hIs lIfe", "you | me"], "string", repair.unconfused_text) == ["love thls", "12th", "what", "his life", "you I me"]
    assert values(spark, ["Every thing is any more", "the me at"], "string", repair.unfragmented) == ["Everything is anymore", "the meat"]


def test_runs_of_words_are_cut_anew():
    split = {"wearegoinghome": "we are going home", "theSat": "the Sat"}.get
    cut = lambda text: repair.rejoined(text, lambda w: split(w, w))
    assert cut("weare goinghome") == "weare goinghome"  # nothing is suspect
    assert cut("(wearegoinghom e), then\nmore") == "(we are going home), then more"
    assert cut("th eSat") == "th eSat"  # too short together
    assert cut("12 - ok") == "12 - ok" and cut("") == ""


def test_hardware(spark):
    backend = lambda want, resized, ok: spark.range(1).select(hardware.resize_backend(F.lit(want), F.lit(resized), {"decode": F.lit(ok)}).alias("b")).first().b
    assert (backend("auto", True, True).backend, backend("auto", True, False).backend, backend("cuda", True, False).backend, backend("cuda", False, False).backend) == ("cuda", "software", None, "software")
    plan = lambda cuda, need: spark.range(1).select(hardware.provider_plan({"cuda": F.lit(cuda), "directml": F.lit(False), "coreml": F.lit(False)}, F.lit(need)).alias("p")).first().p
    assert (plan(True, False), plan(False, False), plan(False, True)) == (["cuda", "cpu"], ["cpu"], None)


def test_pairs_keep_the_first_of_equal_keys(spark):
    from cuewright.functions import text as T

    got = spark.sql("select ' A = 1 ,a=2, =3,b=,c,D=x=y, B=4' as s union all select null").select(T.pairs(F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == [{"a": "1", "d": "x=y", "b": "4"}, None]
