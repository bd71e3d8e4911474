"""SRT text as cues, and cues as SRT and ASS text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS, ass_escape, strip
from ..operators.cues import ass_time, time_text


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole subtitle files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


#: A time line, wherever it stands in a line, and what ends a line.
TIMES = r"([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})\s+-->\s+([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def milliseconds(stamp: Column) -> Column:
    """``HH:MM:SS,mmm`` in milliseconds; null if it is none."""
    part = lambda k, n: F.substring(stamp, k, n).try_cast("long")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3)


def _lines(text: Column) -> Column:
    """The lines, trimmed, without a byte order mark."""
    return F.transform(F.split(F.regexp_replace(text, "^\ufeff", ""), LINE_END), strip)


def _is_number(line: Column) -> Column:
    return line.rlike(r"^\p{Nd}+$")


def srt_cues(files: DataFrame, *, file: str = "file", text: str = "text") -> DataFrame:
    """(file, ord, start_ms, end_ms, text) of SRT texts.

    A cue is a run of text lines; blank lines and time lines end it, lines of digits alone are skipped.
    It has the times of the last time line before it, but none if another cue came between them.  So
    cues that no blank line parts stay apart, and text after a blank line within a cue has no times.
    """
    rows = files.select(file, F.posexplode(_lines(F.col(text))).alias("_at", "_line"))
    so_far = Window.partitionBy(file).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.col("_line").rlike(TIMES)
    kind = F.when(F.col("_line") == "", "blank").when(_is_number(F.col("_line")), "number").when(timed, "time").otherwise("text")
    marked = rows.withColumn("_kind", kind).withColumn("_run", F.count_if(F.col("_kind").isin("blank", "time")).over(so_far)).withColumn("_times", F.last(F.when(F.col("_kind") == "time", F.struct("_at", "_line")), ignorenulls=True).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), " ")
    cues = marked.filter("_kind = 'text'").groupBy(file, "_run").agg(F.min("_at").alias("_at"), F.first("_times").alias("_times"), body.alias("text"))
    in_order = Window.partitionBy(file).orderBy("_at")
    first = F.lag("_times._at").over(in_order).eqNullSafe(F.col("_times._at"))
    stamp = lambda k: F.when(~first | (F.row_number().over(in_order) == 1), milliseconds(F.regexp_extract(F.col("_times._line"), TIMES, k)))
    return cues.select(file, (F.row_number().over(in_order) - 1).alias("ord"), stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), "text")


def srt_tokens(files: DataFrame, *, file: str = "file", text: str = "text") -> DataFrame:
    """(file, tokens, cues): the white-space tokens of all text lines as written, and the number of time lines."""
    rows = files.select(file, _lines(F.col(text)).alias("_lines"))
    words = F.filter(F.col("_lines"), lambda x: (x != "") & ~_is_number(x) & ~x.rlike(TIMES))
    tokens = F.filter(F.split(F.array_join(words, " "), f"{WS}+"), lambda t: t != "")
    return rows.select(file, tokens.alias("tokens"), F.size(F.filter("_lines", lambda x: x.rlike(TIMES))).cast("long").alias("cues"))


def _joined(rows: DataFrame, track: str, line: Column) -> DataFrame:
    """The lines of each track in cue order as one text (a track is one output file)."""
    return rows.groupBy(track).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), "").alias("text"))


def srt_text(cues: DataFrame, *, track: str = "track_id") -> DataFrame:
    """(track, text): numbered cues with their times."""
    n = F.row_number().over(Window.partitionBy(track).orderBy("start_ms", "ord"))
    line = F.concat(F.col("_n").cast("string"), F.lit("\n"), time_text(F.col("start_ms")), F.lit(" --> "), time_text(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return _joined(cues.withColumn("_n", n), track, line)


def ass_text(cues: DataFrame, *, track: str = "track_id", width: int = 1920, height: int = 1080) -> DataFrame:
    """(track, text): a script header with the canvas size, then a dialogue line a cue."""
    head = (
        f"[Script Info]\nScriptType: v4.00+\nPlayResX: {width}\nPlayResY: {height}\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, Alignment\nStyle: Default,Arial,48,&H00FFFFFF,2\n\n"
        "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    )
    n = F.row_number().over(Window.partitionBy(track).orderBy("start_ms", "ord"))
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), ass_escape(F.col("text")), F.lit("\n"))
    return _joined(cues.withColumn("_n", n), track, line).withColumn("text", F.concat(F.lit(head), F.col("text")))


def write_tracks(tracks: DataFrame, folder: str, *, track: str = "track_id") -> None:
    """One folder a track with its text file."""
    tracks.select(track, "text").write.partitionBy(track).mode("overwrite").option("lineSep", "").text(folder)
