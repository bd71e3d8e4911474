"""Landed payloads, subtitles and settings."""

import json

import pytest
from pyspark.sql import functions as F

from cuewright.operators import audit
from cuewright.sources import config, landing, subtitles


def landed(spark, tmp_path, records):
    path = tmp_path / "payload.json"
    path.write_text(json.dumps(records))
    return landing.payloads(spark, str(path))


def test_queue_items(spark, tmp_path):
    raw = landed(spark, tmp_path, [{"id": 1, "status": "queued", "protocol": 2, "episodes": [{"id": 7}, {"id": 8}], "episodeIds": [8, 9], "sizeleft": 3}, {"id": "x", "episode": {"id": 5}, "statusMessages": [{"title": "T", "messages": ["m"]}]}])
    got = sorted((r.id or 0, r.item_id, r.protocol, r.size, r.left) for r in landing.queue_items(raw, "tv").collect())
    assert got == [(0, 5, None, 0, 0), (1, 7, "2", 0, 3)]
    assert sorted(r.item_id for r in landing.active_ids(raw).collect()) == [5, 7, 8, 9]


def test_history_keeps_rows_without_a_date(spark, tmp_path):
    raw = landed(spark, tmp_path, [{"id": k, "eventType": e, "date": d, "episodeId": 1} for k, e, d in [(1, "downloadFolderImported", "2024-01-05T1"), (2, "downloadFolderImported", None), (3, "downloadFolderImported", "2023-01-01"), (4, "grabbed", "2024-01-06")]])
    assert sorted(r.id for r in landing.history(raw, "tv", min_day=19700).collect()) == [1, 2]


def test_movie_release_day(spark, tmp_path):
    base = {"hasFile": True, "movieFileId": 3, "year": 2020}
    raw = landed(spark, tmp_path, [{"id": 1, **base}, {"id": 2, "digitalRelease": "2021-05-01", **base}, {"id": 3, "digitalRelease": None, "inCinemas": "2021-01-01", **base}, {"id": 4, "inCinemas": "2021-01-02", **base}, {"id": 5, "hasFile": False}])
    assert sorted((r.item_id, r.day) for r in landing.movie_inventory(raw).collect()) == [(1, 18262), (2, 18748), (3, None), (4, 18629)]


def test_tv_inventory_and_audit(spark, tmp_path):
    episode = lambda i, **own: {"id": i, "hasFile": True, "episodeFileId": i * 10, "airDate": "2024-01-01", **own}
    raw = landed(spark, tmp_path, [{"episodes": [episode(1, episodeFile={"path": "/a", "mediaInfo": {"audioLanguages": "English / jpn", "subtitles": "eng"}}), episode(2), episode(3, hasFile=False), {"id": 4}]}])
    (tmp_path / "f").mkdir()
    files = landed(spark, tmp_path / "f", [{"id": 20, "languages": [{"name": "French"}]}])
    got = audit.assess(landing.tv_inventory(raw, files), ["eng", "fra"], [])
    assert sorted((r.item_id, r.report.missing_audio, r.missing) for r in got.collect()) == [(1, ["fra"], "audio [fra]"), (2, ["eng"], "audio [eng]")]


def test_releases(spark, tmp_path):
    raw = landed(spark, tmp_path, [{"title": "A", "languages": [{"name": "English"}, "ja"], "subtitleLanguages": "eng,fr", "customFormats": [{"name": "Dub"}, "x"], "protocol": "torrent", "mappedEpisodeInfo": [{"id": 3}]}, {"releaseTitle": "B", "language": {"name": "French"}}])
    got = {r.title: r for r in landing.releases(raw, F.lit(1)).collect()}
    assert (got["A"].languages, got["A"].subtitle_languages, got["A"].custom_formats, got["A"].mapped_ids) == (["eng", "jpn"], ["eng", "fra"], ["Dub", "x"], [3])
    assert got["B"].languages == ["fra"]


def test_release_fields_are_taken_in_one_pass(spark, tmp_path):
    """Odd shapes as before: names of objects, objects without a name, nulls, numbers, records that are no object."""
    raw = landed(spark, tmp_path, [{"title": 1, "protocol": 2, "languages": [{"iso": "fr"}, None, 7, {"x": 1}, "EN-us/und"], "language": {"label": "German; english"}, "customFormats": [{"name": None}, {"name": "N"}, 3], "rejections": ["a", None], "episodeIds": "x"}, "text", {"customFormats": "Dub", "subtitles": {"code": "pt"}, "episodeIds": [1, "2", "y"]}])
    frame = landing.releases(raw, F.lit(1))
    got = [(r.ord, r.title, r.protocol, r.languages, r.subtitle_languages, r.custom_formats, r.rejections, r.episode_ids) for r in frame.orderBy("ord").collect()]
    assert got == [
        (0, "1", "2", ["7", "deu", "eng", "fra", '{"x":1}'], [], ['{"name":null}', "N", "3"], ["a", None], None),
        (1, None, None, [], [], [], None, None),
        (2, None, None, [], ["por"], [], None, [1, 2, None]),
    ]
    assert "$.qualityWeight" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_streams(spark, tmp_path):
    (tmp_path / "probe.json").write_text(json.dumps({"file_id": "f", "container": "mkv", "streams": [{"index": 0, "kind": "video", "codec": "h264", "fps": {"num": 24000, "den": 1001}}, {"index": 1, "kind": "audio", "language": "en"}, {"index": 2, "kind": "subtitle", "codec": "xsub"}]}))
    own = landing.streams(spark, str(tmp_path / "probe.json"))
    assert own.count() == 3 and landing.bitmap_candidates(own).count() == 1 and landing.bitmap_candidates(own, "skip").count() == 0
    r = landing.language_sets(own).first()
    assert (r.present_audio, r.present_subtitles) == (["eng"], [])
    tagged = landing.retagged(own, "jpn", F.lit(True))
    assert [(r["index"], r.language) for r in tagged.filter("retagged").collect()] == [(2, "jpn")]


def test_small_sources(spark, tmp_path):
    assert [tuple(r) for r in landing.environment(spark, "app_", {"APP_TOKEN": "x", "app_b": "y", "other": "z"}).collect()] == [("APP_TOKEN", "***"), ("app_b", "y")]
    (tmp_path / "gpu.csv").write_text("t, 0, 55, x, 100, 20, 60\nbad,1\n")
    assert [tuple(r) for r in landing.gpu_samples(spark, str(tmp_path / "gpu.csv")).collect()] == [(0, 55.0, 100.0, 20.0, 60.0)]
    assert landing.json_table(spark, str(tmp_path / "none.json"), "key string").count() == 0
    (tmp_path / "good.json").write_text('[{"key": "a", "n": 1}, {"key": "b"}]')
    assert [tuple(r) for r in landing.json_table(spark, str(tmp_path / "good.json"), "key string, n bigint").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "bad.json").write_text("{nope")
    assert landing.json_table(spark, str(tmp_path / "bad.json"), "key string").count() == 0
    xml = spark.createDataFrame([('<M><Directory key="1"><Location path="/tv/"/></Directory><Directory><Location path="/x"/></Directory></M>',)], "xml string")
    sections = landing.library_sections(xml)
    assert [tuple(r) for r in sections.collect()] == [("1", "/tv/")]
    dirs = spark.createDataFrame([("/tv/show",), ("/tvx",), ("/tv",)], "directory string")
    assert sorted(r.directory for r in landing.sections_of(dirs, sections).collect()) == ["/tv", "/tv/show"]
    events = spark.createDataFrame([("Download",), ("Test",), (None,)], "e string").select(landing.dispatch(F.col("e")).alias("d"))
    assert [r.d.step for r in events.collect()] == ["plan", "skip", "skip"]
    paths = spark.createDataFrame([("/a/b.mkv",)], "path string")
    assert landing.download_plan(paths, "tv").first().target == "/a/b.fixed.mkv"
    with pytest.raises(ValueError, match="one path"):
        landing.download_plan(paths, "tv", given=["x"])


SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n1984\n\n3\n00:00:05,500 --> 00:00:06,000\nLast\n"


def test_srt_round_trip(spark):
    files = spark.createDataFrame([("f", SRT)], "file string, text string")
    cues = subtitles.srt_cues(files)
    assert [tuple(r)[1:] for r in cues.orderBy("ord").collect()] == [(0, 1000, 2500, "Hello there"), (1, 5500, 6000, "Last")]
    again = subtitles.srt_text(cues.withColumnRenamed("file", "track_id")).select(F.col("track_id").alias("file"), "text")
    assert sorted(map(tuple, subtitles.srt_cues(again).collect())) == sorted(map(tuple, cues.collect()))
    assert subtitles.srt_tokens(files).first().tokens == ["Hello", "there", "Last"]
    ass = subtitles.ass_text(cues.withColumnRenamed("file", "track_id")).first().text
    assert "PlayResX: 1920" in ass and "Dialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,Hello there\n" in ass


def test_srt_without_blank_lines_and_with_inner_ones(spark):
    texts = {
        "glued": "1\n00:00:01,000 --> 00:00:02,000\none\n2\n00:00:03,000 --> 00:00:04,000\ntwo",
        "inner": "1\n00:00:01,000 --> 00:00:02,000\none\n\nmore\n\n7",
        "late": "00:00:01,000 --> 00:00:02,000\n\none\ntwo",
        "none": "just text\n00:00:05.000 --> 00:00:06.000",
        "empty": "",
    }
    got = {}
    for r in subtitles.srt_cues(spark.createDataFrame(list(texts.items()), "file string, text string")).orderBy("file", "ord").collect():
        got.setdefault(r.file, []).append((r.ord, r.start_ms, r.end_ms, r.text))
    assert got == {
        "glued": [(0, 1000, 2000, "one"), (1, 3000, 4000, "two")],
        "inner": [(0, 1000, 2000, "one"), (1, None, None, "more")],
        "late": [(0, 1000, 2000, "one two")],
        "none": [(0, None, None, "just text 00:00:05.000 --> 00:00:06.000")],
    }
    counts = {r.file: (len(r.tokens), r.cues) for r in subtitles.srt_tokens(spark.createDataFrame(list(texts.items()), "file string, text string")).collect()}
    assert counts == {"glued": (2, 2), "inner": (2, 1), "late": (2, 1), "none": (5, 0), "empty": (0, 0)}


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x")
    sums = landing.checksums(spark, str(tmp_path), "*.bin")
    expected = spark.createDataFrame([("a.bin", " BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("b.bin", "00"), ("c.bin", "00")], "name string, sha256 string")
    assert {r.name: r.verdict for r in landing.matches_checksum(sums, expected).collect()} == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "missing"}


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("a = 1\n[language_profiles]\nFR = ' Korean '\n")
    assert config.load(str(tmp_path / "c.toml"), variable="X", default="none")["a"] == 1
    assert config.load(None, variable="X", default=str(tmp_path / "none"), environ={}) == {}
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"), variable="X", default="d")
    assert config.merged({"a": None, "b": 2}, {"a": 5}, {"a": 1, "b": 1, "c": 1}) == {"a": 5, "b": 2, "c": 1}
    assert config.routing(str(tmp_path / "c.toml")).languages == {"fr": "korean"}
    assert config.routing(str(tmp_path / "none")).default == "latin"
