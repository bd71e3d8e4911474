"""Per-stream state: time stamps, circuit breakers, learners, re-chunking, cooldowns.

Each operator takes a streaming frame (or a batch one for ``*_batch``) and groups by its stream, so streams
are independent and state is one small record each.  Within a micro-batch rows are taken in the order of
their ``ord`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that event times of cooldowns are moved by: a watermark begins at 1970, before which all would be late.
#: A second is a millisecond of event time: Arrow hands pandas nanoseconds, which end in 2262.
EPOCH = 2**32
BASELINE_MS, BASELINE_SAMPLES, BASELINE_SHARE = 180_000, 12, 0.85


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    own = list(frames)
    rows = own[0] if len(own) == 1 else pd.concat(own, ignore_index=True)
    order = rows["ord"].to_numpy()
    return rows if (order[1:] >= order[:-1]).all() else rows.sort_values("ord", kind="stable")


def _beside(rows: pd.DataFrame, names: list[str], made: dict[str, list], keep: np.ndarray | slice = slice(None)) -> pd.DataFrame:
    """Columns of the rows kept, then new ones: one frame, as a group is small and each step on a frame costs more than its rows."""
    return pd.DataFrame({name: rows[name].array[keep] for name in names} | made, copy=False)


def _stateful(frame: DataFrame, key: str, step: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], output: str, state: str) -> DataFrame:
    def run(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        made, new = step(_ordered(frames), held.get if held.exists else None)
        held.update(new)
        if len(made):
            yield made

    return frame.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def routed(packets: DataFrame, contexts: DataFrame, *, stream: str = "stream_id") -> DataFrame:
    """Packets with what is known of their stream (kind and more); packets of other streams drop.

    ``contexts`` is a table of the streams that are taken, so this is a join of a stream with a table: no
    state, and each packet is routed as it comes.
    """
    return packets.join(contexts, stream, "inner")


def monotonic(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """Strictly increasing dts of each stream; pts never below a moved dts. Late packets are moved, not dropped."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, out = held[0] if held else None, []
        for dts, pts in zip(rows["dts"].tolist(), rows["pts"].tolist(), strict=True):
            new = dts if last is None or dts > last else last + 1
            out.append((new, max(pts, new) if new > dts else pts))
            last = new
        return _beside(rows, [key, "ord", "dts", "pts"], {"new_dts": [a for a, _ in out], "new_pts": [b for _, b in out]}), (last,)

    kind = packets.schema[key].dataType.simpleString()
    return _stateful(packets, key, step, f"{key} {kind}, ord bigint, dts bigint, pts bigint, new_dts bigint, new_pts bigint", "last bigint")


def breaker(packets: DataFrame, policy: str = "skip", key: str = "stream_id") -> DataFrame:
    """Packets up to a stream's first failure; after it the stream is dropped, or a row says ``abort``."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        open_, out = bool(held[0]) if held else False, []
        if open_:
            return rows.iloc[:0], (True,)
        for failed in rows["failed"].tolist():
            out.append(None if open_ else ("abort" if policy == "fail" else "skip") if failed else "pass")
            open_ = open_ or bool(failed)
        kept = [k for k, outcome in enumerate(out) if outcome is not None]
        return _beside(rows, [key, "ord"], {"outcome": [out[k] for k in kept]}, np.array(kept, int)), (open_,)

    return _stateful(packets, key, step, f"{key} {packets.schema[key].dataType.simpleString()}, ord bigint, outcome string", "open boolean")


def breaker_batch(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """The same over a table, as a window: rows with no failure before them."""
    before = F.max(F.col("failed").cast("int")).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return packets.withColumn("_open", F.coalesce(before, F.lit(0))).filter("_open = 0").drop("_open")


def baseline(samples: DataFrame, key: str = "stream_id") -> DataFrame:
    """Running quality and confidence means over the first three minutes; thresholds after twelve samples."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        n, q_sum, c_sum = held or (0, 0.0, 0.0)
        out = []
        for q, c, t in zip(rows["quality"].tolist(), rows["confidence"].tolist(), rows["t_ms"].tolist(), strict=True):
            if 0 <= t <= BASELINE_MS and 0 <= q <= 1 and 0 <= c <= 1:
                n, q_sum, c_sum = n + 1, q_sum + q, c_sum + c
            ready = n >= BASELINE_SAMPLES
            out.append((n, min(max(q_sum / n * BASELINE_SHARE, 0), 1) if ready else None, min(max(c_sum / n * BASELINE_SHARE, 0), 1) if ready else None))
        made = pd.DataFrame(out, columns=["samples", "min_quality", "min_confidence"])
        made.insert(0, "ord", rows["ord"].to_numpy())
        made.insert(0, key, rows[key].to_numpy())
        return made, (n, q_sum, c_sum)

    return _stateful(samples, key, step, f"{key} {samples.schema[key].dataType.simpleString()}, ord bigint, samples bigint, min_quality double, min_confidence double", "n bigint, q double, c double")


def baseline_batch(samples: DataFrame, key: str = "stream_id") -> DataFrame:
    """The same over a table, as running window sums."""
    counts = (F.col("t_ms").between(0, BASELINE_MS)) & F.col("quality").between(0.0, 1.0) & F.col("confidence").between(0.0, 1.0) & ~F.isnan("quality") & ~F.isnan("confidence")
    so_far = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.sum(F.when(counts, 1)).over(so_far), F.lit(0))
    limit = lambda c: F.when(F.col("samples") >= BASELINE_SAMPLES, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.when(counts, F.col(c))).over(so_far) * BASELINE_SHARE)))
    return samples.withColumn("samples", n).withColumn("min_quality", limit("quality")).withColumn("min_confidence", limit("confidence"))


def rechunk(packets: DataFrame, size: int = 1024, key: str = "stream_id") -> DataFrame:
    """Fixed frames from packets of samples: (stream, frame, n); what is left stays in state until the flush row.

    A row with ``flush`` true emits the remaining samples as a last, shorter frame.
    """

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        frame, left, out = *(held or (0, 0)), []
        for n, flush in zip(rows["samples"].tolist(), rows["flush"].tolist(), strict=True):
            left += n
            while left >= size or (flush and left > 0):
                out.append((frame, min(size, left)))
                frame, left = frame + 1, left - min(size, left)
        made = pd.DataFrame(out, columns=["frame", "n"]).astype("int64")
        made.insert(0, key, rows[key].iloc[0])
        return made, (frame, left)

    return _stateful(packets, key, step, f"{key} {packets.schema[key].dataType.simpleString()}, frame bigint, n bigint", "frame bigint, left bigint")


def rechunk_batch(packets: DataFrame, size: int = 1024, key: str = "stream_id") -> DataFrame:
    """The same over a table: frames by the total of samples."""
    total = packets.groupBy(key).agg(F.sum("samples").alias("_total")).filter("_total > 0")
    frames = total.select(key, "_total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_total") / size) - 1)).alias("frame"))
    return frames.select(key, "frame", F.least(F.lit(size).cast("long"), F.col("_total") - F.col("frame") * size).alias("n"))


def progress(reports: DataFrame, step_percent: float = 5.0, key: str = "job_id") -> DataFrame:
    """Reports worth saying: ``step_percent`` over the last one said, and the first that reaches 100."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, keep = held[0] if held else 0.0, []
        for percent in rows["percent"].tolist():
            said = percent >= last + step_percent or percent >= 100 > last
            keep.append(said)
            last = percent if said else last
        return _beside(rows, [key, "ord", "percent"], {}, np.array(keep, bool)), (last,)

    return _stateful(reports, key, step, f"{key} {reports.schema[key].dataType.simpleString()}, ord bigint, percent double", "last double")


def cooldowns(searches: DataFrame, days: int, key: str = "key", late: timedelta = timedelta(days=30)) -> DataFrame:
    """Whether each search may run: not while the key's last search without result is younger than ``days``.

    Searches carry ``at`` (seconds) and ``found``.  Their event time is ``at``, whatever the clock says: a key's
    state goes when the watermark has passed the end of its cooldown, so that no search still to come can be
    within it, however far the stream lags.  A search more than ``late`` older than the newest one is late and
    drops, as its key's state may be gone.
    """
    window = days * 86400

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = _ordered(frames)
        last, out = held.get[0] if held.exists else None, []
        for at, found in zip(rows["at"].tolist(), rows["found"].tolist(), strict=True):
            allowed = last is None or not 0 <= at - last < window
            out.append(allowed)
            if allowed:
                last = None if found else at
        if last is not None and (ends := last + window + EPOCH) > held.getCurrentWatermarkMs():
            held.update((last,))
            held.setTimeoutTimestamp(ends)
        elif held.exists:
            held.remove()
        yield rows.assign(allowed=out)[[key, "ord", "at", "allowed"]]

    output = f"{key} {searches.schema[key].dataType.simpleString()}, ord bigint, at bigint, allowed boolean"
    timed = searches.withColumn("_at", F.timestamp_millis(F.col("at") + EPOCH)).withWatermark("_at", f"{int(late.total_seconds())} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(run, output, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 day", by: str = "event_type") -> DataFrame:
    """Event-time windows with a watermark, which the per-stream operators above do without."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
