"""The packet loop of a file as one stateful processor: routing by kind, per-stream state, flush at the end.

Packets (file_id, stream, kind, ord, dts, pts, samples, failed, at) go by file through ``transformWithState``.
What is kept of a file are three states:

* ``streams`` (map, by stream): the last dts written, the next pts of audio, and whether the stream is open;
* ``waiting`` (list): audio packets that have not filled a frame yet, as (stream, samples);
* ``file`` (value): packets taken and packets left out.

Video packets get strictly increasing dts.  Audio samples gather to frames of ``frame`` samples.  A subtitle
stream closes with its first failure.  Packets of other kinds are left out.  An event-time timer stands
``gap`` after a file's newest packet: when the watermark passes it the file has ended, its audio tails and a
summary row are written, and its state goes.  Packets older than the watermark are late and dropped by
Spark, which is what keeps a file that ended from beginning again.

Rows are taken in the order of ``ord`` within a micro-batch.  State a file is a record a stream and at most
one frame of samples a stream; files are independent, so a hot file is one film's packets.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: samples of an audio frame.
FRAME = 1024
OUTPUT = "file_id bigint, stream int, kind string, step string, n bigint, dts bigint, pts bigint, size bigint"
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]


class _Stream:
    """What is known of a stream, as the map state's row."""

    def __init__(self, kind: str, last_dts: int | None = None, next_pts: int = 0, frames: int = 0, open_: bool = True) -> None:
        self.kind, self.last_dts, self.next_pts, self.frames, self.open = kind, last_dts, next_pts, frames, open_

    def row(self) -> tuple:
        return self.kind, self.last_dts, self.next_pts, self.frames, self.open


class Demux(StatefulProcessor):
    def __init__(self, gap: timedelta, frame: int) -> None:
        self.gap_ms, self.frame = int(gap.total_seconds() * 1000), frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streams = handle.getMapState("streams", "stream int", "kind string, last_dts bigint, next_pts bigint, frames bigint, open boolean")
        self.waiting = handle.getListState("waiting", "stream int, samples bigint")
        self.file = handle.getValueState("file", "taken bigint, left_out bigint, ends bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        packets = pd.concat(list(rows), ignore_index=True).sort_values("ord", kind="stable")
        taken, left_out, ends = self.file.get() if self.file.exists() else (0, 0, None)
        known = {s[0]: _Stream(*v) for s, v in self.streams.iterator()} if self.streams.exists() else {}
        waiting: dict[int, int] = {}
        for stream, samples in self.waiting.get() if self.waiting.exists() else ():
            waiting[stream] = waiting.get(stream, 0) + samples
        out: list[tuple] = []
        for p in packets.itertuples(index=False):
            own = known.setdefault(p.stream, _Stream(p.kind))
            if p.kind == "video":
                self._video(key[0], own, p, out)
            elif p.kind == "audio":
                waiting[p.stream] = self._frames(key[0], p.stream, own, waiting.get(p.stream, 0) + int(p.samples), out, flush=False)
            elif p.kind == "subtitle" and own.open:
                own.open = not p.failed
                out.append((key[0], p.stream, p.kind, "skip" if p.failed else "write", p.ord, p.dts, p.pts, None))
            else:
                left_out += 1
                continue
            taken += 1
        for stream, own in known.items():
            self.streams.updateValue((stream,), own.row())
        if left := [(s, n) for s, n in waiting.items() if n]:
            self.waiting.put(left)
        else:  # a list state holds no empty list
            self.waiting.clear()
        newest = int(packets["at"].max().timestamp() * 1000) + self.gap_ms
        if ends is None or newest > ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(newest)
            ends = newest
        self.file.update((taken, left_out, ends))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        left = {}
        for stream, samples in self.waiting.get() if self.waiting.exists() else ():
            left[stream] = left.get(stream, 0) + samples
        for (stream,), values in sorted(self.streams.iterator(), key=lambda x: x[0][0]) if self.streams.exists() else ():
            self._frames(key[0], stream, _Stream(*values), left.get(stream, 0), out, flush=True)
        taken, left_out, _ = self.file.get()
        out.append((key[0], None, "file", "end", taken, None, None, left_out))
        for state in (self.streams, self.waiting, self.file):
            state.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass

    @staticmethod
    def _video(file_id: int, own: _Stream, p: object, out: list[tuple]) -> None:
        dts = p.dts if own.last_dts is None or p.dts > own.last_dts else own.last_dts + 1
        own.last_dts = dts
        out.append((file_id, p.stream, p.kind, "write", p.ord, dts, max(p.pts, dts) if dts > p.dts else p.pts, None))

    def _frames(self, file_id: int, stream: int, own: _Stream, samples: int, out: list[tuple], *, flush: bool) -> int:
        """Writes full frames, and the tail if flushing; the samples that are left."""
        while samples >= self.frame or flush and samples:
            size = min(samples, self.frame)
            out.append((file_id, stream, "audio", "flush" if size < self.frame else "write", own.frames, own.next_pts, own.next_pts, size))
            own.frames, own.next_pts, samples = own.frames + 1, own.next_pts + size, samples - size
        return samples


def demuxed(packets: DataFrame, *, gap: timedelta, late: timedelta = timedelta(0), frame: int = FRAME) -> DataFrame:
    """What is written of each file's packets; ``packets`` is a stream with an event time ``at`` and no packet without a kind.

    Needs the RocksDB state store, which this sets for the session.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = packets.withWatermark("at", f"{int(late.total_seconds() * 1000)} milliseconds")
    return timed.groupBy("file_id").transformWithStateInPandas(Demux(gap, frame), OUTPUT, "append", "eventTime")
