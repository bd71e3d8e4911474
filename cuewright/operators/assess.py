"""Whether a file plays directly on the target devices, and whether an output is what was planned."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import BITMAP_SUBTITLES, LEVELS, PROFILES
from ..functions.releases import yes

CRITERIA = ("resolution", "bitrate", "fps")


class Target(NamedTuple):
    container: str
    video_codec: str
    audio_codec: str
    max_profile: int | None = None
    max_level: int | None = None
    max_fps: float | None = None
    max_width: int | None = None
    max_height: int | None = None
    max_video_bitrate: int | None = None
    max_audio_bitrate: int | None = None
    quality_width: int | None = None
    quality_height: int | None = None


def h264_reasons(codec: Column, profile: Column, level: Column, max_profile: int | None, max_level: int | None) -> list[Column]:
    """Reasons of an H.264 stream; none for other codecs."""
    if max_profile is None or max_level is None:
        return []
    own = yes(codec == "h264")
    bad_profile = ~yes(profile.isin(*PROFILES))
    bad_level = ~yes(level.isin(*LEVELS))
    return [
        F.when(own & bad_profile, "unknown H.264 profile").when(own & (profile > max_profile), "H.264 profile above limit"),
        F.when(own & bad_level, "unknown H.264 level").when(own & (level > max_level), "H.264 level above limit"),
    ]


def stream_reasons(target: Target) -> Column:
    """All reasons why a stream row does not play; an empty array if it does."""
    kind, codec = F.col("kind"), F.col("codec")
    video, audio, text = yes(kind == "video"), yes(kind == "audio"), yes(kind == "subtitle")
    over = lambda column, limit: F.col(column) > F.lit(limit) if limit is not None else F.lit(False)
    reasons = [
        F.when(yes(kind.isin("attachment", "data")) | yes(F.col("attached_picture")), "attachment or attached picture"),
        F.when(video & ~yes(codec == target.video_codec), "video codec"),
        F.when(video & yes(over("width", target.max_width) | over("height", target.max_height)), "larger than the devices play"),
        F.when(video & yes(over("width", target.quality_width) | over("height", target.quality_height)), "larger than the quality"),
        F.when(video & yes(over("bitrate", target.max_video_bitrate)), "video bit rate"),
        F.when(video & yes(F.col("fps") > F.lit((target.max_fps or 1e9) + 0.5)), "frame rate"),
        *(F.when(video, r) for r in h264_reasons(codec, F.col("profile"), F.col("level"), target.max_profile, target.max_level)),
        F.when(audio & ~yes(codec == target.audio_codec), "audio codec"),
        F.when(audio & yes(over("bitrate", target.max_audio_bitrate)), "audio bit rate"),
        F.when(text & yes(codec.isin(*BITMAP_SUBTITLES)) & F.lit(target.container == "mp4"), "bitmap subtitles in mp4"),
    ]
    return F.array_compact(F.array(*reasons))


def direct_play(streams: DataFrame, target: Target, file: str = "file_id") -> DataFrame:
    """(file, reasons, compatible): every reason of every stream, in stream order; compatible iff none."""
    container = F.when(~yes(F.col("container") == target.container), F.array(F.lit("container"))).otherwise(F.array().cast("array<string>"))
    judged = streams.withColumn("_own", stream_reasons(target))
    found = judged.groupBy(file).agg(F.first(container).alias("_container"), F.transform(F.array_sort(F.collect_list(F.when(F.size("_own") > 0, F.struct("index", "_own")))), lambda s: s["_own"]).alias("_streams"))
    reasons = F.concat(F.col("_container"), F.flatten("_streams"))
    return found.select(file, reasons.alias("reasons"), (F.size(reasons) == 0).alias("compatible"))


def is_plain() -> Column:
    """Whether a stream (kind, attached_picture) is no attachment, data or cover picture."""
    return ~yes(F.col("kind").isin("attachment", "data")) & ~yes(F.col("attached_picture"))


def without_auxiliary(streams: DataFrame) -> DataFrame:
    return streams.filter(is_plain())


def score(criteria: str, width: Column, height: Column, bitrate: Column, fps: Column) -> Column:
    """A struct that orders video streams by one criterion, then the others."""
    parts = {"resolution": (F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))), "bitrate": F.coalesce(bitrate, F.lit(0)).cast("long"), "fps": F.coalesce(fps, F.lit(0.0))}
    order = [criteria, *(c for c in CRITERIA if c != criteria)]
    return F.struct(*(parts[c].alias(c) for c in order))


def primary_video(streams: DataFrame, criteria: str = "resolution", file: str = "file_id") -> DataFrame:
    """(file, index): the best video stream of each file; of equal ones the first.

    The criterion, then the area (for resolution: the bit rate); rates in whole thousandths.
    """
    area = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0))
    rate = F.greatest(F.coalesce(F.col("bitrate"), F.lit(0)).cast("long"), F.lit(0))
    fps = F.greatest(F.floor(F.coalesce(F.col("fps"), F.lit(0.0)) * 1000), F.lit(0))
    rank = {"resolution": (area, rate), "bitrate": (rate, area), "fps": (fps, area)}[criteria]
    return streams.filter("kind = 'video'").groupBy(file).agg(F.max_by("index", F.struct(*rank, -F.col("index"))).alias("index"))


def extra_video(streams: DataFrame, primary: DataFrame, policy: str, file: str = "file_id") -> DataFrame:
    """What becomes of each video stream: ``primary``, or what the policy says of others."""
    outcome = {"convert": "convert", "ignore": "drop", "fail": "error"}[policy]
    first = primary.select(file, F.col("index").alias("_primary"))
    return streams.filter("kind = 'video'").join(first, file, "left").withColumn("outcome", F.when(F.col("index") == F.col("_primary"), "primary").otherwise(outcome)).drop("_primary")


def output_errors(streams: DataFrame, video_codec: str, audio_codec: str, file: str = "file_id") -> DataFrame:
    """(file, errors): what an output file lacks of its contract."""
    kind, codec = F.col("kind"), F.col("codec")
    flags = streams.groupBy(file).agg(
        F.bool_or(yes((kind == "video") & ((F.coalesce(F.col("width"), F.lit(0)) <= 0) | (F.coalesce(F.col("height"), F.lit(0)) <= 0)))).alias("empty"),
        F.bool_or(yes((kind == "video") & (codec == video_codec))).alias("video"),
        F.bool_or(yes((kind == "audio") & (codec == audio_codec))).alias("audio"),
        F.bool_or(yes(kind.isin("attachment", "data"))).alias("extra"),
    )
    errors = F.array_compact(F.array(F.when(F.col("empty"), "video without size"), F.when(~F.col("video"), "no video of the planned codec"), F.when(~F.col("audio"), "no audio of the planned codec"), F.when(F.col("extra"), "attachment or data stream")))
    return flags.select(file, errors.alias("errors"))


def profile_check(streams: DataFrame, profile: int, level: int, file: str = "file_id") -> DataFrame:
    """(file, verdict) of the first video stream: its profile and level must equal the plan's."""
    first = Window.partitionBy(file).orderBy("index")
    own = streams.filter("kind = 'video'").withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    same = yes((F.col("codec") == "h264") & (F.col("profile") == profile) & (F.col("level") == level))
    return own.select(file, F.when(same, "verified").otherwise("mismatch").alias("verdict"))


def visual_settings(frames: int, interval: int, ratio: float) -> None:
    if frames <= 0 or interval <= 0 or not 0 < ratio <= 1:
        raise ValueError("frames and interval must be positive and the ratio in (0, 1]")
