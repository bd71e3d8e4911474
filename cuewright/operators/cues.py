"""Subtitle cues: intervals in milliseconds, in order within a track."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import strip

TOLERANCE_MS = 350


def interval(base: Column, start: Column, end: Column, duration: Column) -> Column:
    """struct(start_ms, end_ms): not before 0; an empty one lasts ``duration``, a second at least."""
    a = F.greatest(base + start, F.lit(0))
    b = F.greatest(base + end, a)
    return F.struct(a.alias("start_ms"), F.when(b > a, b).otherwise(a + F.greatest(duration, F.lit(1000))).alias("end_ms"))


def sanitise(cues: DataFrame, *, truncate: bool = True, track: str = "track_id") -> DataFrame:
    """Cues cut at the next one's start (SRT), then those with a length and text.

    Of two cues with equal starts the earlier is emptied and so dropped.
    """
    following = F.lead("start_ms").over(Window.partitionBy(track).orderBy("start_ms", "ord"))
    end = F.least("end_ms", F.coalesce(following, F.col("end_ms"))) if truncate else F.col("end_ms")
    return cues.withColumn("end_ms", end).filter((F.col("end_ms") > F.col("start_ms")) & (strip(F.col("text")) != ""))


def strictly_increasing(packets: DataFrame, *, stream: str = "stream_id", dts: str = "dts", pts: str = "pts", order: str = "ord") -> DataFrame:
    """Adds new_dts, at least one over the one before, and new_pts, at least new_dts where it was moved.

    Closed form: the running maximum of dts minus place, plus place.
    """
    so_far = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(stream).orderBy(order))
    moved = packets.withColumn("_place", place).withColumn("new_dts", F.max(F.col(dts) - F.col("_place")).over(so_far) + F.col("_place"))
    new_pts = F.when(F.col("new_dts") > F.col(dts), F.greatest(F.col(pts), F.col("new_dts"))).otherwise(F.col(pts))
    return moved.withColumn("new_pts", new_pts).drop("_place")


def subtitle_pts(packets: DataFrame, *, stream: str = "stream_id", order: str = "ord") -> DataFrame:
    """Adds pts_out: the subtitle's, else the packet's, else one over the last known, else 0.

    Rows without a time follow the last row with one, so they count up from it.
    """
    own = F.coalesce("subtitle_pts", "packet_pts")
    so_far = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = packets.withColumn("_own", own).withColumn("_run", F.count("_own").over(so_far))
    in_run = Window.partitionBy(stream, "_run").orderBy(order)
    since = F.row_number().over(in_run) - 1
    start = F.first("_own").over(in_run)
    return grouped.withColumn("pts_out", F.coalesce(start + since, since.cast("long"))).drop("_own", "_run")


def progress(reports: DataFrame, *, job: str = "job_id", order: str = "ord", step: float = 5.0) -> DataFrame:
    """The reports that are said: ``step`` percent over the last one said, and the first that reaches 100.

    One pass over rows sorted by job and order: a task holds one batch and the last report said.
    """

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0.0
        for batch in batches:
            kept = []
            for k, (own, percent) in enumerate(zip(batch.column(job).to_pylist(), batch.column("percent").to_pylist(), strict=True)):
                if own != now or k == 0 and now is None:
                    now, last = own, 0.0
                if percent is not None and percent == percent and (percent >= last + step or percent >= 100 > last):
                    kept.append(k)
                    last = percent
            yield batch.take(pa.array(kept, pa.int64()))

    return reports.repartition(job).sortWithinPartitions(job, order).mapInArrow(say, reports.schema)


def time_text(ms: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm``."""
    part = lambda unit, modulus: F.floor(ms / unit) % modulus if modulus else F.floor(ms / unit)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), (ms % 1000).cast("long"))


def ass_time(ms: Column) -> Column:
    """``H:MM:SS.cc``."""
    part = lambda unit, modulus: F.floor(ms / unit) % modulus if modulus else F.floor(ms / unit)
    return F.format_string("%d:%02d:%02d.%02d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), part(10, 100))


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over candidate pairs sorted by track, reference cue and preference: each reference cue in order takes
    the first hypothesis cue that is still free.

    A task holds the cues taken in one chain: those of a chain cannot be candidates in another.
    """
    now, done, used = None, None, set()
    for batch in batches:
        track, chain, ref, hyp = (batch.column(k).to_pylist() for k in range(4))
        kept = []
        for k, own in enumerate(zip(track, chain, strict=True)):
            if own != now:
                now, done, used = own, None, set()
            if ref[k] != done and hyp[k] not in used:
                done = ref[k]
                used.add(hyp[k])
                kept.append(k)
        yield batch.take(pa.array(kept, pa.int64()))


def align(reference: DataFrame, hypothesis: DataFrame, *, track: str = "track_id", tolerance_ms: int = TOLERANCE_MS, bin_ms: int = 10_000) -> DataFrame:
    """One row a pair and a row for each cue without a partner: track, ref_ord, hyp_ord, overlap, delta and texts.

    Cues meet by equal time bins, widened by the tolerance, so candidates cost no cross product; of the
    bins that two cues share only the first makes the pair.  Chains of cues that could compete are cut
    where a gap separates them; a task reads candidates in order and holds the taken cues of one chain.
    A cue without times, or of a track that only one side has, gets no partner.
    """
    first = lambda a: F.floor((F.col(a) - tolerance_ms) / bin_ms)
    bins = F.explode(F.sequence(first("start_ms"), F.floor((F.greatest("end_ms", "start_ms") + tolerance_ms) / bin_ms)))
    side = lambda df, key, a, b: df.filter("start_ms is not null and end_ms is not null").select(track, F.col("ord").alias(key), F.col("start_ms").alias(a), F.col("end_ms").alias(b), bins.alias("bin"))
    r, h = side(reference, "ref_ord", "r0", "r1"), side(hypothesis, "hyp_ord", "h0", "h1")
    overlap = F.greatest(F.least("r1", "h1") - F.greatest("r0", "h0"), F.lit(0))
    near = r.join(h, [track, "bin"]).filter(F.col("bin") == F.greatest(first("r0"), first("h0"))).withColumn("overlap", overlap).withColumn("delta", F.abs(F.col("r0") - F.col("h0"))).filter((F.col("overlap") > 0) | (F.col("delta") <= tolerance_ms))
    # a chain ends where the next pair begins after every pair before it has ended
    order = Window.partitionBy(track).orderBy("_a", "ref_ord", "hyp_ord")
    timed = near.withColumn("_a", F.least("r0", "h0") - tolerance_ms).withColumn("_b", F.greatest("r1", "h1", "r0", "h0") + tolerance_ms)
    before = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = timed.withColumn("chain", F.sum(F.when(F.col("_a") > before, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = chained.select(track, "chain", "ref_ord", "hyp_ord", "overlap", "delta")
    sorted_ = pairs.repartition(track, "chain").sortWithinPartitions(track, "chain", "ref_ord", F.col("overlap").desc(), "delta", "hyp_ord")
    chosen = sorted_.mapInArrow(_assigned, pairs.schema).drop("chain")
    texts = lambda df, key, name: df.select(track, F.col("ord").alias(key), F.col("text").alias(name))
    left = texts(reference, "ref_ord", "ref_text").join(chosen, [track, "ref_ord"], "left")
    return left.join(texts(hypothesis, "hyp_ord", "hyp_text"), [track, "hyp_ord"], "full").select(track, "ref_ord", "hyp_ord", "overlap", "delta", "ref_text", "hyp_text")


def zip_by_order(reference: DataFrame, hypothesis: DataFrame, *, track: str = "track_id") -> DataFrame:
    """Cues paired by place, as far as both tracks go."""
    place = F.row_number().over(Window.partitionBy(track).orderBy("ord"))
    side = lambda df, name: df.select(track, place.alias("place"), F.col("text").alias(name))
    return side(reference, "ref_text").join(side(hypothesis, "hyp_text"), [track, "place"])


def _lines_of(boxes: list[dict]) -> list[dict]:
    """Lines of one cue's boxes, which come by (top, left); text, score and box of each."""
    found: list[list[dict]] = []
    for box in boxes:
        centre = (box["top"] + box["bottom"]) / 2
        for line in found:
            mean = sum((b["top"] + b["bottom"]) / 2 for b in line) / len(line)
            height = sum(b["bottom"] - b["top"] for b in line) / len(line)
            if abs(centre - mean) <= max(0.6 * height, 4):
                line.append(box)
                break
        else:
            found.append([box])
    out = []
    for line in found:
        line.sort(key=lambda b: b["left"])
        gap = max(0.25 * sum(b["bottom"] - b["top"] for b in line) / len(line), 2)
        text = line[0]["text"] + "".join((" " if b["left"] - a["right"] > gap else "") + b["text"] for a, b in zip(line, line[1:], strict=False))
        scores = [b["score"] for b in line if b["score"] is not None and b["score"] == b["score"]]
        out.append({"text": text, "score": sum(scores) / len(scores) if scores else None, "left": min(b["left"] for b in line), "top": min(b["top"] for b in line), "right": max(b["right"] for b in line), "bottom": max(b["bottom"] for b in line)})
    return sorted(out, key=lambda x: (x["top"], x["left"]))


def merge_boxes(boxes: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    """Lines of recognised boxes (left, top, right, bottom, text, score): cue, line, text, score and box.

    Boxes by (top, left) join the first line whose mean centre is near; within a line, by left, a gap
    over a quarter of the mean height is a space.  A task reads boxes in order and holds those of one
    cue, which is one image.
    """
    names = ["left", "top", "right", "bottom", "text", "score"]
    made = [cue, "line", "text", "score", "left", "top", "right", "bottom"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def closed() -> list[dict]:
            return [{cue: now, "line": k} | line for k, line in enumerate(_lines_of(held))]

        for batch in batches:
            rows = []
            for own, box in zip(batch.column(0).to_pylist(), batch.select(names).to_pylist(), strict=True):
                if held and own != now:
                    rows += closed()
                    held = []
                now = own
                held.append(box)
            yield pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_pylist(closed(), schema)

    read = boxes.select(cue, *(F.col(c).cast("int") for c in names[:4]), F.col("text"), F.col("score").cast("double"))
    kind = read.schema[cue].dataType
    schema = pa.schema([pa.field(cue, to_arrow_type(kind)), pa.field("line", pa.int32()), pa.field("text", pa.string()), pa.field("score", pa.float64()), *(pa.field(c, pa.int32()) for c in names[:4])])
    sorted_ = read.repartition(cue).sortWithinPartitions(cue, "top", "left")
    return sorted_.mapInArrow(lines, f"{cue} {kind.simpleString()}, line int, text string, score double, left int, top int, right int, bottom int").select(*made)


#: A line is read word by word if it has so many crops, and so many of them must be read.
LEAST_CROPS, MOST_CROPS, LEAST_READ = 2, 80, 2


def word_crops(crops: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    """Lines assembled from words that were recognised one by one (left, top, right, bottom, text, score).

    Only cues of 2 to 80 crops are read so; crops without text drop, and two must be left.
    """
    counted = crops.withColumn("_read", strip(F.coalesce("text", F.lit(""))) != "")
    fit = counted.groupBy(cue).agg(F.count("*").alias("_n"), F.count_if("_read").alias("_m")).filter(F.col("_n").between(LEAST_CROPS, MOST_CROPS) & (F.col("_m") >= LEAST_READ)).select(cue)
    return merge_boxes(counted.filter("_read").drop("_read").join(fit, cue, "left_semi"), cue=cue)


def ink_runs(rows: DataFrame, *, image: str = "image_id", least: int = 4) -> DataFrame:
    """Bands of consecutive rows with ink, at least ``least`` high: image, top and bottom (exclusive).

    Gaps and islands: place minus running number is constant within a run.
    """
    order = Window.partitionBy(image).orderBy("y")
    inked = rows.filter("ink").withColumn("_island", F.col("y") - F.row_number().over(order))
    bands = inked.groupBy(image, "_island").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))
    return bands.filter(F.col("bottom") - F.col("top") >= least).drop("_island")


def column_spans(columns: DataFrame, *, band: list[str], gap: Column) -> DataFrame:
    """Spans of inked columns (x) of a band, cut where ``gap`` blank columns or more follow each other."""
    order = Window.partitionBy(*band).orderBy("x")
    inked = columns.filter("ink").withColumn("_new", F.when(F.col("x") - F.lag("x").over(order) > gap, 1).otherwise(0))
    numbered = inked.withColumn("span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*band, "span").agg(F.min("x").alias("left"), (F.max("x") + 1).alias("right"))


def greedy_decode(symbols: DataFrame, *, sequence: str = "sequence_id", blank: int = 0) -> DataFrame:
    """(sequence, symbols): blanks and repeats of the symbol before dropped."""
    before = F.lag("symbol").over(Window.partitionBy(sequence).orderBy("step"))
    kept = symbols.withColumn("_keep", (F.col("symbol") != blank) & (before.isNull() | (before != F.col("symbol"))))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("step", "symbol")))), lambda s: s["symbol"])
    return kept.groupBy(sequence).agg(listed.alias("symbols"))


def sidecar_paths(tracks: DataFrame, *, stem: Column, language: Column, file: str = "file_id") -> DataFrame:
    """Adds path: ``stem.lang.srt``, and ``stem.lang.n.srt`` for the n-th track of a language."""
    n = F.row_number().over(Window.partitionBy(file, language).orderBy("ord"))
    suffix = F.when(n == 1, F.lit(".srt")).otherwise(F.concat(F.lit("."), n.cast("string"), F.lit(".srt")))
    return tracks.withColumn("path", F.concat(stem, F.lit("."), language, suffix))
