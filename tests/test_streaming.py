"""Stateful operators over several micro-batches, against their batch forms or plain loops."""

import pytest
from pyspark.sql import functions as F

from cuewright.streaming import stateful


def streamed(spark, tmp_path, batches, schema, operator, name):
    """The operator's rows after each list of rows has been a micro-batch."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b={k}"))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    query = operator(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_monotonic(spark, tmp_path):
    batches = [[(1, 0, 5, 5), (1, 1, 5, 9), (2, 0, 1, 1)], [(1, 2, 3, 3), (2, 1, 9, 9)]]
    got = streamed(spark, tmp_path, batches, "stream_id int, ord bigint, dts bigint, pts bigint", stateful.monotonic, "monotonic")
    assert sorted((r.stream_id, r.ord, r.new_dts, r.new_pts) for r in got.collect()) == [(1, 0, 5, 5), (1, 1, 6, 9), (1, 2, 7, 7), (2, 0, 1, 1), (2, 1, 9, 9)]


@pytest.mark.parametrize("policy", ["skip", "fail"])
def test_breaker(spark, tmp_path, policy):
    batches = [[(1, 0, False), (1, 1, True)], [(1, 2, False), (2, 0, False)]]
    got = streamed(spark, tmp_path, batches, "stream_id int, ord bigint, failed boolean", lambda s: stateful.breaker(s, policy), f"breaker_{policy}")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "pass"), (1, 1, {"skip": "skip", "fail": "abort"}[policy]), (2, 0, "pass")]


def test_baseline_equals_batch(spark, tmp_path):
    rows = [(1, k, (k % 13) / 10, (k % 7) / 10, k * 9000) for k in range(40)]
    schema = "stream_id int, ord bigint, quality double, confidence double, t_ms bigint"
    got = streamed(spark, tmp_path, [rows[:15], rows[15:]], schema, stateful.baseline, "baseline")
    near = lambda df: sorted((r.ord, r.samples, r.min_quality and round(r.min_quality, 9), r.min_confidence and round(r.min_confidence, 9)) for r in df.collect())
    want = near(stateful.baseline_batch(spark.createDataFrame(rows, schema)))
    assert near(got) == want
    assert [w[2] is None for w in want].count(True) > 10 and want[-1][1] < 21


def test_rechunk(spark, tmp_path):
    batches = [[(1, 0, 700, False), (1, 1, 700, False)], [(1, 2, 700, True)]]
    schema = "stream_id int, ord bigint, samples bigint, flush boolean"
    got = streamed(spark, tmp_path, batches, schema, stateful.rechunk, "rechunk")
    want = stateful.rechunk_batch(spark.createDataFrame([r for b in batches for r in b], schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 0, 1024), (1, 1, 1024), (1, 2, 52)]


def test_progress_and_cooldowns(spark, tmp_path):
    got = streamed(spark, tmp_path / "p", [[(1, 0, 4.0), (1, 1, 6.0)], [(1, 2, 10.0), (1, 3, 100.0)]], "job_id int, ord bigint, percent double", stateful.progress, "progress")
    assert [r.ord for r in got.orderBy("ord").collect()] == [1, 3]
    day = 86400
    got = streamed(spark, tmp_path / "c", [[("k", 0, 0, False), ("k", 1, day, False)], [("k", 2, 2 * day, True), ("k", 3, 2 * day + 1, False)]], "key string, ord bigint, at bigint, found boolean", lambda s: stateful.cooldowns(s, 2), "cooldowns")
    assert [(r.ord, r.allowed) for r in got.orderBy("ord").collect()] == [(0, True), (1, False), (2, True), (3, True)]


def test_cooldowns_go_by_event_time(spark, tmp_path):
    day = 86400
    rows = [[("k", 0, 100 * day, False), ("j", 1, 100 * day, False)], [("other", 2, 131 * day, False), ("j", 3, 101 * day, False)], [("k", 4, 102 * day + 1, False), ("late", 5, 100 * day, False), ("j", 6, 101 * day + 5, False)], [("j", 7, 140 * day, False), ("late", 8, 100 * day, False)]]
    got = streamed(spark, tmp_path, rows, "key string, ord bigint, at bigint, found boolean", lambda s: stateful.cooldowns(s, 2), "event_time")
    # Spark takes rows by the watermark of the batch before: 100 days are late in the fourth; all others are judged by what was held
    assert [(r.ord, r.allowed) for r in got.orderBy("ord").collect()] == [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (6, False), (7, True)]


def test_cooldowns_of_far_centuries(spark, tmp_path):
    day = 86400
    rows = [[("k", 0, -40 * 365 * day, False)], [("k", 1, 200_000 * day, False), ("k", 2, 200_001 * day, False)], [("k", 3, 40_000_000 * day, False), ("j", 4, 40_000_000 * day, False)], [("k", 5, 40_000_001 * day, False)]]
    got = streamed(spark, tmp_path, rows, "key string, ord bigint, at bigint, found boolean", lambda s: stateful.cooldowns(s, 2), "centuries")
    assert [(r.ord, r.at, r.allowed) for r in got.orderBy("ord").collect()] == [(0, -40 * 365 * day, True), (1, 200_000 * day, True), (2, 200_001 * day, False), (3, 40_000_000 * day, True), (4, 40_000_000 * day, True), (5, 40_000_001 * day, False)]


def test_windows_with_a_watermark(spark, tmp_path):
    rows = [[("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0)], [("2024-01-03 00:00:00", "a", 1.0)]]
    frames = [[(ts, e, v) for ts, e, v in b] for b in rows]
    schema = "ts string, event_type string, value double"
    got = streamed(spark, tmp_path, frames, schema, lambda s: stateful.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp"))), "windows")
    assert [(r.n, r.total) for r in got.collect()] == [(2, 3.0)]


def test_steps_make_one_frame_a_group():
    """F15, F16, F18: rows in order are not sorted or gathered anew, an open breaker gives no frame; odd orders still are."""
    import pandas as pd

    from cuewright.streaming.stateful import _beside, _ordered

    rows = pd.DataFrame({"k": ["a", "a", "a"], "ord": [1, 1, 2]}, index=[5, 6, 7])
    assert _ordered(iter([rows])) is rows
    assert _ordered(iter([rows.iloc[::-1]]))["ord"].tolist() == [1, 1, 2]
    assert _ordered(iter([rows.iloc[2:], rows.iloc[:2]]))["ord"].tolist() == [1, 1, 2]
    assert _beside(rows, ["k", "ord"], {"new": [1, 3]}, [0, 2]).to_dict("list") == {"k": ["a", "a"], "ord": [1, 2], "new": [1, 3]}
