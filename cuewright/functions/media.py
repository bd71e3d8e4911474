"""Expressions over dimensions, bit rates, codecs and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .releases import yes
from .text import ascii_lower, lookup, strip

#: Quality tiers with their size and bit rate; match-source has no limit.
VIDEO_TIERS = [
    ("match-source", None, None, None),
    ("360p", 640, 360, 1_200_000),
    ("480p", 854, 480, 2_500_000),
    ("720p", 1280, 720, 5_000_000),
    ("1080p", 1920, 1080, 8_000_000),
    ("1440p", 2560, 1440, 16_000_000),
    ("2160p", 3840, 2160, 35_000_000),
]
AUDIO_TIERS = [("match-source", None), ("320k", 320_000), ("256k", 256_000), ("224k", 224_000), ("192k", 192_000), ("160k", 160_000), ("128k", 128_000), ("96k", 96_000)]
#: Other names of the tiers.
VIDEO_ALIASES = {
    "match-source": ["source", "auto", "original", "input"],
    "360p": ["sd", "sd360", "low"],
    "480p": ["sd480", "dvd", "standard"],
    "720p": ["hd", "hd-ready", "1280x720"],
    "1080p": ["full-hd", "fhd", "1920x1080"],
    "1440p": ["qhd", "2k", "2560x1440"],
    "2160p": ["uhd", "4k", "3840x2160"],
}
AUDIO_ALIASES = {"match-source": ["source", "auto", "original"], "320k": ["very-high", "studio"], "256k": ["high", "itunes"], "224k": ["broadcast"], "192k": ["standard", "cd"], "160k": ["medium-high"], "128k": ["medium", "default"], "96k": ["low", "speech"]}

#: Most kilobits a second, and of buffer, of High profile at each level (5.2: no limit).
LEVEL_RATES = {10: (80, 175), 11: (240, 500), 12: (480, 1000), 13: (960, 2000), 20: (2500, 2000), 21: (4000, 4000), 22: (4000, 4000), 30: (12500, 10000), 31: (17500, 14000), 32: (25000, 20000), 40: (25000, 25000), 41: (62500, 62500), 42: (62500, 62500), 50: (135000, 135000), 51: (240000, 240000)}
LEVELS = (*LEVEL_RATES, 52)
PROFILES = {66: "baseline", 77: "main", 88: "extended", 100: "high", 110: "high10", 122: "high422", 244: "high444"}
RESOLUTIONS = [("480p", 640, 480), ("720p", 1280, 720), ("1080p", 1920, 1080), ("1440p", 2560, 1440), ("2160p", 3840, 2160)]

BITMAP_SUBTITLES = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub")


def ladder(value: Column, steps: list[tuple[float, object]], top: object) -> Column:
    """The result of the first step that the value does not exceed."""
    out = F.lit(top)
    for limit, result in reversed(steps):
        out = F.when(value <= limit, F.lit(result)).otherwise(out)
    return out


def resolution_of(width: Column, height: Column) -> Column:
    """The named resolution; 1080p for unknown pairs."""
    return lookup(F.concat_ws("x", width.cast("string"), height.cast("string")), {f"{w}x{h}": name for name, w, h in RESOLUTIONS}, F.lit("1080p"))


def level_name(level: Column) -> Column:
    """``41`` as ``4.1``, ``40`` as ``4``; null for numbers that are no level."""
    tenths = level % 10
    text = F.concat((level / 10).cast("int").cast("string"), F.when(tenths == 0, "").otherwise(F.concat(F.lit("."), tenths.cast("string"))))
    return F.when(level.isin(*LEVELS), text)


def profile_name(profile: Column) -> Column:
    return lookup(profile.cast("int"), PROFILES)


def tier(name: Column, aliases: dict[str, list[str]]) -> Column:
    names = {word: t for t, words in aliases.items() for word in (t, *words)}
    return lookup(ascii_lower(strip(name)), names)


def name_tier(explicit: Column, height: Column) -> Column:
    """The quality that a file name is to carry: the explicit tier, else that of the resolved height, else match-source."""
    named = tier(explicit, VIDEO_ALIASES)
    by_height = lookup(height.cast("int"), {h: name for name, _, h, _ in VIDEO_TIERS if h}, F.lit("match-source"))
    return F.when(named.isNotNull() & (named != "match-source"), named).otherwise(by_height)


def target_bitrate(source: Column, limit: Column) -> Column:
    """The smaller of both, the limit for an unknown source, the source without a limit; else null."""
    return F.when(limit > 0, F.when(source > 0, F.least(source, limit)).otherwise(limit)).when(limit.isNull() & (source > 0), source)


def video_bitrate_for(width: Column, height: Column) -> Column:
    """The usual bit rate for a size."""
    return ladder(F.greatest(width, height, F.lit(1)), [(640, 1_200_000), (854, 2_500_000), (1280, 5_000_000), (1920, 8_000_000), (2560, 16_000_000)], 35_000_000)


def video_preset(width: Column, height: Column, bitrate: Column) -> Column:
    """The preset's name for a log line: it compares the larger side with heights, as is the custom here."""
    rate = F.when(bitrate > 0, bitrate).otherwise(video_bitrate_for(width, height))
    named = ladder(F.greatest(width, height, F.lit(1)), [(360, "360p"), (480, "480p"), (720, "720p"), (1080, "1080p"), (1440, "1440p")], "more")
    return F.when(named != "more", named).when(rate >= 30_000_000, "2160p").otherwise("1440p")


def audio_preset(bitrate: Column) -> Column:
    """The nearest preset; of two as near the smaller; 192k for an unknown bit rate."""
    rate = F.when(bitrate > 0, bitrate).otherwise(F.lit(192_000))
    options = F.array(*(F.struct(F.abs(rate - bps).alias("off"), F.lit(bps).alias("bps"), F.lit(name).alias("name")) for name, bps in AUDIO_TIERS if bps))
    return F.array_min(options)["name"]


def _even(value: Column) -> Column:
    return F.when((value > 2) & (value % 2 != 0), value - 1).otherwise(value)


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def clamped_size(width: Column, height: Column, cap_width: Column, cap_height: Column) -> Column:
    """struct(width, height) inside a cap, never enlarged, sides even, the width a multiple of 16 if scaled.

    The height is fitted again to each multiple of 16 downwards until it is within the cap.
    """
    w, h = width.cast("int"), height.cast("int")
    most_w, most_h = F.greatest(cap_width, F.lit(2)).cast("int"), F.greatest(cap_height, F.lit(2)).cast("int")
    scale = F.least(most_w / w, most_h / h)
    side = lambda source: F.when(source >= 2, F.least(F.greatest(_half_up(source * scale), F.lit(2)), source)).otherwise(source)
    even = lambda v: F.when(v % 2 != 0, F.greatest(v - 1, F.lit(2))).otherwise(v)
    sw, sh = even(side(w)), even(side(h))
    top = F.least((sw / 16).cast("int"), F.greatest((most_w / 16).cast("int"), F.lit(1)))
    fitted = F.transform(
        F.sequence(top, F.lit(1), F.lit(-1)),
        lambda k: F.struct((k * 16).alias("width"), (lambda y: y + y % 2)(F.greatest(_half_up(k * 16 / (w / h)), F.lit(2))).alias("height")),
    )
    aligned = F.try_element_at(F.filter(fitted, lambda s: s["height"] <= most_h), F.lit(1))
    pair = lambda a, b: F.struct(a.cast("int").alias("width"), b.cast("int").alias("height"))
    return (
        F.when((w <= 0) | (h <= 0), pair(F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))))
        .when((w <= most_w) & (h <= most_h), pair(F.greatest(_even(w), F.lit(1)), F.greatest(_even(h), F.lit(1))))
        .when((sw >= 16) & (sw % 16 != 0), F.coalesce(aligned, pair(sw, sh)))
        .otherwise(pair(sw, sh))
    )


def rational(num: Column, den: Column) -> Column:
    """num / den; null unless both are positive."""
    return F.when((num > 0) & (den > 0), num / den)


def frame_rate(guessed: Column, average: Column) -> Column:
    """The guessed rate if there is one, else the average one; null over 300."""
    rate = F.coalesce(guessed, average)
    return F.when(rate <= 300, rate)


def rescaled(value: Column, num: Column, den: Column, target_num: Column, target_den: Column) -> Column:
    """A time stamp in another time base, rounded half away from zero; null stays null."""
    exact = value.cast("decimal(20,0)") * num.cast("decimal(10,0)") * target_den.cast("decimal(8,0)")
    return F.round(exact / (den.cast("decimal(10,0)") * target_num.cast("decimal(8,0)"))).cast("long")


def container_of(demuxers: Column, extension: Column) -> Column:
    """The container of a demuxer list such as ``mov,mp4,m4a``; the extension tells mp4, m4v and mov apart."""
    names = F.split(ascii_lower(demuxers), ",")
    ext = ascii_lower(extension)
    has = lambda *of: F.arrays_overlap(names, F.array(*map(F.lit, of)))
    return F.when(has("mov", "mp4", "m4v", "m4a"), F.when(ext.isin("m4v", "mov"), ext).otherwise("mp4")).when(has("matroska", "webm"), "mkv").when(has("mpegts"), "ts")


def subtitle_codec(rich: Column, container: Column) -> Column:
    """mov_text in mp4; in mkv ass for styled and subrip for plain text; else mov_text."""
    return F.when(container == "mkv", F.when(rich, "ass").otherwise("subrip")).otherwise("mov_text")


def encoder_rates(bitrate: Column, level: Column) -> Column:
    """struct(rate, peak, buffer): the peak and buffer are twice the rate, all within the level's limits."""
    limits = lookup(level.cast("int"), {k: v[0] * 1000 for k, v in LEVEL_RATES.items()}), lookup(level.cast("int"), {k: v[1] * 1000 for k, v in LEVEL_RATES.items()})
    within = lambda value, limit: F.least(value.cast("long"), F.coalesce(limit.cast("long"), value.cast("long")))
    return F.when(bitrate > 0, F.struct(within(bitrate, limits[0]).alias("rate"), within(bitrate * 2, limits[0]).alias("peak"), within(bitrate * 2, limits[1]).alias("buffer")))


def time_base(fps_num: Column, fps_den: Column, base_num: Column, base_den: Column) -> Column:
    """The inverse frame rate; else the decoder's base, but 1001/24000 if that implies over 300 frames a second."""
    pair = lambda a, b: F.struct(a.cast("int").alias("num"), b.cast("int").alias("den"))
    return F.when((fps_num > 0) & (fps_den > 0), pair(fps_den, fps_num)).when(base_den / base_num > 300, pair(F.lit(1001), F.lit(24000))).otherwise(pair(base_num, base_den))


def canvas(codec: Column, width: Column, height: Column, stream_width: Column, stream_height: Column, video_width: Column, video_height: Column) -> Column:
    """A bitmap subtitle's canvas where the decoder knows none: per axis the larger of stream and video."""
    missing = codec.isin(*BITMAP_SUBTITLES) & ((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0))
    wide = lambda a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    return F.when(missing, F.struct(wide(stream_width, video_width).alias("width"), wide(stream_height, video_height).alias("height"))).otherwise(F.struct(width.alias("width"), height.alias("height")))


def temporal(stream_seconds: Column, container_seconds: Column, stream_fps: Column, frames: Column) -> Column:
    """struct(seconds, fps): the stream's, else the container's length; the stream's rate, else frames by length."""
    seconds = F.coalesce(F.when(stream_seconds > 0, stream_seconds), F.when(container_seconds > 0, container_seconds))
    return F.struct(seconds.alias("seconds"), F.coalesce(stream_fps, F.when((frames > 0) & (seconds > 0), frames / seconds)).alias("fps"))


def rate_collapsed(source: Column, output: Column) -> Column:
    """Whether the output kept its length but lost over a fifth of its frames; false where anything is unknown."""
    return yes((source["fps"] >= 10) & (output["seconds"] / source["seconds"] >= 0.90) & (output["fps"] / source["fps"] < 0.80))


def green_frame(mean: Column, deviation: Column, u: Column, v: Column) -> Column:
    bias = (128 - u) + (128 - v)
    return yes((mean > 25) & (deviation < 55) & (u < 100) & (v < 115) & (bias > 45))


def near_solid(mean: Column, deviation: Column) -> Column:
    return yes((mean > 25) & (mean < 235) & (deviation < 2.5))


def overlap_union(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of left, top, right, bottom)."""
    side = lambda low, high: F.greatest(high - low, F.lit(0))
    area = lambda x: side(x["left"], x["right"]) * side(x["top"], x["bottom"])
    inner = side(F.greatest(a["left"], b["left"]), F.least(a["right"], b["right"])) * side(F.greatest(a["top"], b["top"]), F.least(a["bottom"], b["bottom"]))
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def box_area(box: Column) -> Column:
    return F.greatest(box["right"] - box["left"], F.lit(0)) * F.greatest(box["bottom"] - box["top"], F.lit(0))


def colour_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in "rgb"), F.lit(0.0)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)
