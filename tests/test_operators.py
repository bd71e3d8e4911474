"""DataFrame operators on literal frames and against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import assess, audit, cues, devices, evaluation, frames, hardware, queue, telemetry
from cuewright.sources import landing, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_every_device_plays_the_common_profile(spark):
    all_ = devices.catalogue(spark)
    assert all_.count() == 18
    common = devices.resolve(all_).withColumn("id", F.lit(1))
    assert devices.playable_everywhere(common, all_, "id").first().everywhere
    assert [r.model for r in devices.pick(all_, models=[" Roku_Ultra ", "nest_hub", "roku_ultra"]).collect()] == ["nest_hub", "roku_ultra"]


def test_audit_searches_releases_of_asked_items_alone(spark):
    """A search gets the items within the budget; the others' releases are not asked for."""
    files = spark.createDataFrame([(k, k, "Japanese", "", None) for k in range(6)], "item_id bigint, day int, info_audio string, info_subtitles string, languages array<string>")
    none = spark.createDataFrame([], "key string, requirements string, checked_at bigint")
    history = spark.createDataFrame([], "id bigint, item_id bigint, date string, event_type string")
    asked = []

    def search(items):
        asked.extend(r.item_id for r in items.collect())
        return landing.releases(landing.records(items.select("item_id", F.lit('[{"languages":["eng","jpn"]}]').alias("body")), "body", "item_id"), F.col("item_id"))

    actions, _ = audit.language_audit(files, files.filter("item_id = 5").select("item_id"), none, search, history, audio=["eng", "jpn"], subtitles=[], policy="strict", now=F.lit(0), cooldown_days=0, budget=2, kind="movie")
    assert sorted(asked) == [3, 4]
    assert rows(actions, "item_id", "action") == [(3, "would-grab"), (4, "would-grab")]


def test_best_release_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([(1, 0, "torrent", 5), (1, 1, "usenet", 5), (1, 2, "usenet", 5), (1, 3, "torrent", 9)], "item_id bigint, ord bigint, protocol string, custom_format_score bigint")
    for name, kind in (("title", "string"), ("release_type", "string"), ("quality_weight", "bigint"), ("episode_id", "bigint"), ("rejected", "boolean"), ("download_allowed", "boolean")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    for name, kind in (("languages", "string"), ("subtitle_languages", "string"), ("custom_formats", "string"), ("rejections", "string"), ("mapped_ids", "bigint"), ("episode_ids", "bigint"), ("episode_numbers", "bigint"), ("absolute_numbers", "bigint")):
        df = df.withColumn(name, F.lit(None).cast(f"array<{kind}>"))
    pick = lambda prefer: audit.best_release(df, [], [], "strict", prefer_non_torrent=prefer, episodes=False).first().release.ord
    assert (pick(True), pick(False)) == (2, 3)


def test_cooldown(spark):
    missing = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id bigint")
    cool = spark.createDataFrame([("tv:e:1", "a", 0), ("tv:e:2", "b", 0), ("tv:e:3", "a", -5 * 86400)], "key string, requirements string, checked_at bigint")
    got = audit.cooled(missing, cool, F.lit(86401), 5, kind="tv", noun="e", requirements=F.lit("a"))
    assert rows(got, "item_id", "days_left") == [(1, 4), (2, None), (3, None), (4, None)]


def test_newest_missing_first(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 9)], "item_id bigint, day int")
    assert [r.item_id for r in audit.within_budget(df, 3).collect()] == [4, 3, 1]


def test_actions(spark):
    df = spark.createDataFrame([(1, 10, "r"), (2, None, "r"), (3, 10, None)], "item_id bigint, history_id bigint, release string")
    assert rows(audit.redownload_actions(df, dry_run=False), "item_id", "step", "action") == [(1, 0, "grab"), (1, 1, "mark-failed"), (2, 0, "refused"), (3, 0, "no-candidate")]
    assert {r.action for r in audit.redownload_actions(df, dry_run=True).collect()} == {"would-grab", "no-candidate"}


def test_summaries_merge(spark):
    a = spark.createDataFrame([(1, 2)], "checked bigint, errors bigint")
    assert tuple(audit.merge_summaries(a, a, a).first()) == (3, 6)


def test_queue_needs_all_of_stale(spark):
    schema = "id bigint, status string, state string, tracked string, protocol string, size bigint, left bigint, added string, error string, messages array<struct<title:string,messages:array<string>>>"
    base = ("queued", "downloading", "ok", "torrent", 0, 0, "2024-01-01", None, None)
    q = spark.createDataFrame([(1, *base), (2, *base[:4], 5, 0, *base[6:]), (3, *base[:6], None, None, None), (4, "completed", "importPending", "warning", "usenet", None, None, "2024-01-01", None, [("t", ["Wrong Season"])]), (5, "completed", "x", "ok", "usenet", 0, 0, None, None, None)], schema)
    today = F.lit(19754)
    assert rows(queue.with_reasons(q, today, 10).filter("reason is not null"), "id", "reason") == [(1, "stale zero-size torrent queue item"), (4, "episode mismatch or multi-episode pack")]
    assert rows(queue.with_reasons(q, today, 0).filter("reason is not null"), "id") == [(4,)]


def greedy(ref, hyp, tolerance=350):
    used, out = set(), {}
    for r, (r0, r1) in enumerate(ref):
        best, key = None, None
        for h, (h0, h1) in enumerate(hyp):
            overlap, delta = max(0, min(r1, h1) - max(r0, h0)), abs(r0 - h0)
            if h not in used and (overlap > 0 or delta <= tolerance) and (key is None or (overlap, -delta) > key):
                best, key = h, (overlap, -delta)
        if best is not None:
            used.add(best)
        out[r] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_align(spark, seed):
    rng = random.Random(seed)

    def track(n):
        at, out = 0, []
        for _ in range(n):
            at += rng.randrange(0, 4000)
            out.append((at, at + rng.randrange(0, 3000)))
        return out

    ref, hyp = track(40), track(35)
    frame = lambda cs, name: spark.createDataFrame([("t", k, a, b, f"{name}{k}") for k, (a, b) in enumerate(cs)], "track_id string, ord bigint, start_ms bigint, end_ms bigint, text string")
    got = cues.align(frame(ref, "r"), frame(hyp, "h"), bin_ms=5000).collect()
    assert {r.ref_ord: r.hyp_ord for r in got if r.ref_ord is not None} == greedy(ref, hyp)
    assert sorted(r.hyp_ord for r in got if r.hyp_ord is not None) == list(range(len(hyp)))


def test_align_tolerance_and_competition(spark):
    frame = lambda cs: spark.createDataFrame([("t", k, a, b, "x") for k, (a, b) in enumerate(cs)], "track_id string, ord bigint, start_ms bigint, end_ms bigint, text string")
    near = lambda d: {r.ref_ord: r.hyp_ord for r in cues.align(frame([(1000, 1000)]), frame([(1000 + d, 5000)])).collect() if r.ref_ord is not None}
    assert (near(350), near(351)) == ({0: 0}, {0: None})
    both = cues.align(frame([(0, 100), (50, 150)]), frame([(40, 140)])).collect()
    assert {r.ref_ord: r.hyp_ord for r in both} == {0: 0, 1: None}


def test_align_is_greedy_by_reference_cue(spark):
    rng = random.Random(9)
    track = lambda n: [(a := rng.randrange(6000), a + rng.choice([0, 200, 900])) for _ in range(n)]
    sides = {t: (track(rng.randint(0, 14)), track(rng.randint(0, 14))) for t in range(25)}
    frame = lambda side: spark.createDataFrame([(t, k, a, b, "x") for t, own in sides.items() for k, (a, b) in enumerate(own[side])], "track_id int, ord bigint, start_ms bigint, end_ms bigint, text string")
    want = set()
    for t, (ref, hyp) in sides.items():
        used = set()
        for i, (a, b) in enumerate(ref):
            best = None
            for j, (c, d) in enumerate(hyp):
                overlap, delta = max(0, min(b, d) - max(a, c)), abs(a - c)
                if j not in used and (overlap > 0 or delta <= 350) and (best is None or (overlap, -delta) > best[0]):
                    best = (overlap, -delta), j
            want.add((t, i, best[1] if best else None))
            used |= {best[1]} if best else set()
        want |= {(t, None, j) for j in range(len(hyp)) if j not in used}
    for bin_ms in (500, 10_000):
        assert {(r.track_id, r.ref_ord, r.hyp_ord) for r in cues.align(frame(0), frame(1), bin_ms=bin_ms).collect()} == want


def test_rates_of_a_track(spark):
    pairs = spark.createDataFrame([("t", 0, 0, "one two", "one two"), ("t", 1, None, "three", None), ("t", None, 1, None, "four")], "track_id string, ref_ord bigint, hyp_ord bigint, ref_text string, hyp_text string")
    r = evaluation.roll_up(pairs).first()
    assert (r.reference_words, r.hypothesis_words, r.word_edits, round(r.wer, 6), r.accepted) == (3, 3, 1, round(1 / 3, 6), False)
    assert [round(x.similarity, 3) for x in evaluation.worst(evaluation.with_pair_similarity(pairs), 2).collect()] == [0.0, 0.0]


def test_edits_of_any_length():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 90))) for _ in range(2))
        assert evaluation.edits(a, b) == plain(a, b)
    assert evaluation.edits("ab" * 20_000, "ba" * 20_000) == 2


def test_text_that_moves_between_cues_costs_nothing(spark):
    pairs = spark.createDataFrame([("t", 0, 0, "one two", "one"), ("t", 1, 1, "three", "two three")], "track_id string, ref_ord bigint, hyp_ord bigint, ref_text string, hyp_text string")
    r = evaluation.roll_up(pairs).first()
    assert (r.word_edits, r.char_edits, r.accepted) == (0, 0, True)


def test_boxes_and_ink(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10, "ab", 0.5), (1, 20, 1, 30, 11, "cd", 1.0), (1, 31, 0, 40, 10, "e", None), (1, 0, 30, 10, 40, "z", 1.0)], "cue_id int, left int, top int, right int, bottom int, text string, score double")
    assert [(r.text, r.score, r.right) for r in cues.merge_boxes(boxes).orderBy("line").collect()] == [("ab cde", 0.75, 40), ("z", 1.0, 10)]
    ink = spark.createDataFrame([(1, y, y in (1, 2, 3, 4, 7, 8)) for y in range(10)], "image_id int, y int, ink boolean")
    assert rows(cues.ink_runs(ink), "top", "bottom") == [(1, 5)]
    spans = spark.createDataFrame([(1, x, x in (0, 1, 5, 6, 12)) for x in range(14)], "image_id int, x int, ink boolean")
    assert rows(cues.column_spans(spans, band=["image_id"], gap=F.lit(4)), "left", "right") == [(0, 7), (12, 13)]


def test_progress(spark):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate([1.0, 5.0, 9.0, 10.0, 98.0, 99.0, 100.0, 100.0])], "job_id int, ord bigint, percent double")
    assert [r.percent for r in cues.progress(df).orderBy("ord").collect()] == [5.0, 10.0, 98.0, 100.0]


def test_gpu_percentiles(spark):
    for n, want in ((1, 1.0), (19, 18.0), (20, 19.0), (21, 19.0)):
        df = spark.createDataFrame([(0, float(k + 1)) for k in range(n)], "gpu int, util double")
        assert telemetry.gpu_summary(df).first().p95 == want


def test_green_failure_needs_three_frames(spark):
    green = (100.0, 10.0, 50.0, 50.0)
    df = spark.createDataFrame([(1, *green)] * 2 + [(2, *green)] * 3 + [(3, 100.0, 1.0, None, None)] * 3, "file_id int, luma_mean double, luma_deviation double, u_mean double, v_mean double")
    assert rows(frames.visual_report(df, 0.5), "file_id", "green_failure", "solid_failure") == [(1, False, False), (2, True, False), (3, False, True)]


def test_hysteresis(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.55), (1, 2, "c", 0.7)], "g int, ord int, name string, quality double")
    assert hardware.best_candidate(df, 0.1, "g").first().name == "c"
    assert hardware.best_candidate(df.filter("ord < 2"), 0.1, "g").first().name == "a"


def test_streams(spark):
    df = spark.createDataFrame([("f", 0, "video", 10, 10, 5, 24.0), ("f", 1, "video", 10, 10, 5, 24.0), ("f", 2, "video", 5, 5, 9, 60.0)], "file_id string, index int, kind string, width int, height int, bitrate bigint, fps double")
    assert [assess.primary_video(df, c).first()["index"] for c in assess.CRITERIA] == [0, 2, 2]
    with pytest.raises(ValueError, match="positive"):
        assess.visual_settings(0, 1, 0.5)


def test_upsert_and_split(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], "key string, at bigint, v string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", 1, "added")], "key string, at bigint, v string")
    assert [tuple(r) for r in sinks.upsert(table, new, "key", "at").collect()] == [("a", 2, "new"), ("b", 5, "kept"), ("c", 1, "added")]
    labels = spark.createDataFrame([(f"line {k}",) for k in range(30)], "text string")
    made = sinks.split_labels(labels, seed=5, validation=F.col("text") == "line 3", val_count=6)
    assert made.filter("split = 'val'").count() == 6 and made.count() == 30
    assert made.filter("text = 'line 3'").first().split == "val"
    repeated = labels.unionByName(labels).withColumn("flag", F.lit(None).cast("boolean"))
    both = sinks.split_labels(repeated, seed=5, validation=F.col("flag"), val_count=7)
    assert both.count() == 60 and both.filter("split = 'val'").count() == 8  # whole texts
    assert both.groupBy("text").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_report(spark):
    df = spark.createDataFrame([("pure", "eng", 0.1, 0.2, 0.9, True, 3.0, False), ("pure", "fra", 0.3, 0.2, 0.5, False, 5.0, True)], "mode string, language string, cer double, wer double, similarity double, meets_threshold boolean, infer_ms double, used_fallback boolean")
    text = sinks.report_markdown(evaluation.summarise_modes(df)).first().markdown
    assert "| all | 2 | 0.2000" in text and "| fra | 1 |" in text
