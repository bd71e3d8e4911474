"""Paged scans that stop early, and the packet loop over several runs."""

import json
from datetime import datetime, timedelta

import pytest

from cuewright.sources.paged import day_of, paged
from cuewright.streaming.demux import demuxed


def put(root, source, pages):
    for k, body in enumerate(pages, 1):
        folder = root / f"source={source}" / f"page={k}"
        folder.mkdir(parents=True)
        (folder / "body.json").write_text(body if isinstance(body, str) else json.dumps({"records": body}))


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    far = "9999-01-01T00:00:00Z"
    put(root, "long", [*([{"id": k, "eventType": "grabbed", "date": far}] for k in range(1, 11)), [{"id": 1234, "eventType": "downloadFolderImported", "date": far}], []])
    put(root, "old", [[{"id": 1, "date": "2024-01-05"}, {"id": 2}], [{"id": 3, "date": "2024-01-01"}, {"id": 5, "date": None}, {"id": 6, "date": "2024-01-04"}], [{"id": 4, "date": far}]])
    put(root, "broken", ["no json", [{"id": 7, "date": far}]])
    put(root, "odd", [[3, {"id": "x", "eventType": 5, "date": "2024-13-01"}, {"id": True}]])
    return str(root)


LIMIT = day_of("2024-01-03")


def test_pages_are_read_until_the_first_older_record(spark, pages):
    opened = {r.source: (r.opened, r.stopped) for r in paged(spark, pages, min_day=LIMIT, report=True).collect()}
    assert opened == {"long": (12, "an empty page"), "old": (2, "an older record"), "broken": (1, "an empty page"), "odd": (1, "the last page")}
    got = {(r.source, r.id) for r in paged(spark, pages, min_day=LIMIT).filter("source <> 'odd'").collect()}
    assert got == {("long", k) for k in [*range(1, 11), 1234]} | {("old", 1), ("old", 2), ("old", 5), ("old", 6)}
    odd = paged(spark, pages, min_day=LIMIT).filter("source = 'odd'").collect()
    assert [(r.ord, r.id, r.event_type, r.day) for r in odd] == [(0, None, None, None), (1, None, None, None), (2, None, None, None)]
    assert paged(spark, pages, max_pages=3, report=True).filter("source = 'long'").first().opened == 3


def test_all_pages_of_a_long_history_are_read(spark, tmp_path):
    put(tmp_path, "s", [[{"id": k, "date": "2024-01-05"}] for k in range(1, 1104)])
    assert paged(spark, str(tmp_path), max_pages=0).count() == 1103
    assert [tuple(r) for r in paged(spark, str(tmp_path), max_pages=0, report=True).collect()] == [("s", 1103, "the last page")]
    assert [tuple(r) for r in paged(spark, str(tmp_path), report=True).collect()] == [("s", 1000, "the page limit")]
    assert [tuple(r) for r in paged(spark, str(tmp_path), max_pages=1103, report=True).collect()] == [("s", 1103, "the last page")]


def test_a_day_filter_is_pushed_into_the_scan(spark, pages):
    rows = paged(spark, pages).filter(f"day >= {LIMIT} and source = 'old'").collect()
    assert sorted(r.id for r in rows) == [1, 6]  # page 3 would hold 4, undated records drop
    assert paged(spark, pages).filter(f"source = 'old' and day > {day_of('2024-01-04')}").count() == 1


def run(spark, root, parts, **how):
    """What each part appends, run after run from one checkpoint."""
    schema = "file_id bigint, stream int, kind string, ord bigint, dts bigint, pts bigint, samples bigint, failed boolean, at timestamp"
    seen, out = set(), []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        made = demuxed(spark.readStream.schema(schema).parquet(f"{root}/in"), **how)
        made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        rows = {tuple(r) for r in spark.read.schema(made.schema).parquet(f"{root}/out").collect()}
        out.append(rows - seen)
        seen |= rows
    return out


def test_packets_by_kind_with_flush_by_timer_and_late_packets(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    packet = lambda file, stream, kind, ord_, dts, samples, minutes, failed=False: (file, stream, kind, ord_, dts, dts, samples, failed, at(minutes))
    parts = [
        [packet(1, 0, "video", 1, 5, 0, 0), packet(1, 0, "video", 2, 5, 0, 0), packet(1, 1, "audio", 3, 0, 1500, 1), packet(1, 2, "subtitle", 4, 9, 0, 1), packet(1, 3, "data", 5, 0, 0, 1)],
        [packet(1, 0, "video", 6, 3, 0, 2), packet(1, 1, "audio", 7, 0, 600, 2), packet(1, 2, "subtitle", 8, 10, 0, 2, True), packet(1, 2, "subtitle", 9, 11, 0, 2)],
        [packet(2, 1, "audio", 10, 0, 10, 90)],  # moves the watermark past the end of file 1
        [packet(1, 0, "video", 11, 1, 0, 3), packet(2, 1, "audio", 12, 0, 1014, 91), packet(1, 0, "video", 13, 2, 0, 92)],  # the first is late
        [packet(3, 1, "audio", 14, 0, 1, 900)],
    ]
    got = run(spark, tmp_path, parts, gap=timedelta(minutes=30))
    assert got[0] == {(1, 0, "video", "write", 1, 5, 5, None), (1, 0, "video", "write", 2, 6, 6, None), (1, 1, "audio", "write", 0, 0, 0, 1024), (1, 2, "subtitle", "write", 4, 9, 9, None)}
    assert got[1] == {(1, 0, "video", "write", 6, 7, 7, None), (1, 1, "audio", "write", 1, 1024, 1024, 1024), (1, 2, "subtitle", "skip", 8, 10, 10, None)}
    assert got[2] == {(1, 1, "audio", "flush", 2, 2048, 2048, 52), (1, None, "file", "end", 7, None, None, 2)}
    assert got[3] == {(2, 1, "audio", "write", 0, 0, 0, 1024), (1, 0, "video", "write", 13, 2, 2, None)}  # file 1 anew
    assert got[4] == {(2, None, "file", "end", 2, None, None, 0), (1, None, "file", "end", 1, None, None, 0)}
