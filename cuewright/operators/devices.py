"""The device dimension, what a set of devices has in common, and output plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import target_bitrate
from ..functions.text import ascii_lower, strip

SCHEMA = "ord int, name string, model string, maker string, family string, containers array<string>, video_codecs array<string>, audio_codecs array<string>, max_profile int, max_level int, max_fps int, max_width int, max_height int, max_video_bitrate bigint, max_audio_bitrate bigint"

#: Name, model, video codecs, level, fps, height, video and audio bit rate of each device.
_CATALOGUE = {
    ("Google", "chromecast", ("mp4",), ("aac",)): [
        ("Chromecast (1st gen)", "chromecast_1st_gen", ["h264"], 41, 30, 1080, 20_000_000, 320_000),
        ("Chromecast (2nd gen)", "chromecast_2nd_gen", ["h264"], 41, 60, 1080, 20_000_000, 320_000),
        ("Chromecast (3rd gen)", "chromecast_3rd_gen", ["h264", "vp8"], 42, 60, 1080, 25_000_000, 320_000),
        ("Chromecast Ultra", "chromecast_ultra", ["h264", "vp8"], 42, 60, 2160, 35_000_000, 320_000),
        ("Chromecast with Google TV", "chromecast_google_tv", ["h264", "hevc", "vp9"], 51, 60, 2160, 45_000_000, 320_000),
        ("Google TV Streamer", "google_tv_streamer", ["h264", "hevc", "vp9"], 52, 60, 2160, 45_000_000, 320_000),
        ("Nest Hub", "nest_hub", ["h264", "vp9"], 41, 60, 720, 12_000_000, 256_000),
        ("Nest Hub Max", "nest_hub_max", ["h264", "vp9"], 41, 30, 720, 12_000_000, 256_000),
    ],
    ("Roku", "roku", ("mp4", "mkv"), ("aac", "ac3", "eac3", "dts")): [
        ("Roku Express", "roku_express", ["h264", "hevc"], 41, 60, 1080, 20_000_000, 640_000),
        ("Roku Streaming Stick 4K", "roku_streaming_stick_4k", ["h264", "hevc"], 51, 60, 2160, 40_000_000, 1_536_000),
        ("Roku Ultra", "roku_ultra", ["h264", "hevc"], 51, 60, 2160, 40_000_000, 1_536_000),
    ],
    ("Apple", "apple_tv", ("mp4", "m4v", "mov"), ("aac", "ac3", "eac3")): [
        ("Apple TV HD", "apple_tv_hd", ["h264"], 42, 60, 1080, 20_000_000, 640_000),
        ("Apple TV 4K (1st gen)", "apple_tv_4k_1st_gen", ["h264", "hevc"], 51, 60, 2160, 35_000_000, 768_000),
        ("Apple TV 4K (2nd gen)", "apple_tv_4k_2nd_gen", ["h264", "hevc"], 51, 60, 2160, 40_000_000, 768_000),
        ("Apple TV 4K (3rd gen)", "apple_tv_4k_3rd_gen", ["h264", "hevc"], 52, 60, 2160, 40_000_000, 768_000),
    ],
    ("Amazon", "fire_tv", ("mp4", "mkv"), ("aac", "ac3", "eac3", "flac")): [
        ("Fire TV Stick 4K", "fire_tv_stick_4k", ["h264", "hevc", "av1"], 51, 60, 2160, 35_000_000, 1_024_000),
        ("Fire TV Stick 4K Max", "fire_tv_stick_4k_max", ["h264", "hevc", "av1"], 51, 60, 2160, 40_000_000, 1_024_000),
        ("Fire TV Cube (3rd gen)", "fire_tv_cube_3rd_gen", ["h264", "hevc", "av1"], 52, 60, 2160, 40_000_000, 1_024_000),
    ],
}
_WIDTH = {720: 1280, 1080: 1920, 2160: 3840}


def catalogue(spark: SparkSession) -> DataFrame:
    """The 18 devices; High profile is the most that any of them plays."""
    rows = [
        (name, model, maker, family, list(containers), video, list(audio), 100, level, fps, _WIDTH[height], height, v, a)
        for (maker, family, containers, audio), own in _CATALOGUE.items()
        for name, model, video, level, fps, height, v, a in own
    ]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def pick(devices: DataFrame, *, models: list[str] | None = None, family: str | None = None) -> DataFrame:
    """Devices by model (case and outer spaces aside) or family, each model once, sorted by model."""
    if models is not None:
        devices = devices.filter(ascii_lower(strip(F.col("model"))).isin([m.strip().lower() for m in models]))
    if family is not None:
        devices = devices.filter(F.col("family") == family.strip().lower().replace("-", "_").replace(" ", "_"))
    return devices.dropDuplicates(["model"]).orderBy("model")


def _common(column: str) -> Column:
    """What all devices of a group have, in the order of the first one's list."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("model", column))), lambda s: s[column])
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.try_element_at(lists, F.lit(1)), lambda kept, own: F.array_intersect(kept, own))


def _smallest_size() -> Column:
    """Taken over by a device that is narrower or lower, in the order of the models."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("model", "max_width", "max_height"))), lambda s: F.struct(s["max_width"].alias("width"), s["max_height"].alias("height")))
    first = F.struct(F.lit(1 << 30).alias("width"), F.lit(1 << 30).alias("height"))
    return F.aggregate(sizes, first, lambda least, own: F.when((own["width"] < least["width"]) | (own["height"] < least["height"]), own).otherwise(least))


def resolve(devices: DataFrame, *group: str) -> DataFrame:
    """One row a group (all devices without one): common lists, minima, and the target profile.

    A device table is a dimension of a few rows, so its lists may be gathered.  A null codec or
    container says that the devices have none in common; null bit rates are no limit.
    """
    found = devices.groupBy(*group).agg(
        _common("containers").alias("containers"), _common("video_codecs").alias("video_codecs"), _common("audio_codecs").alias("audio_codecs"),
        F.min("max_profile").alias("min_profile"), F.min("max_level").alias("min_level"), F.min("max_fps").alias("max_fps"),
        _smallest_size().alias("size"), F.min("max_video_bitrate").alias("max_video_bitrate"), F.min("max_audio_bitrate").alias("max_audio_bitrate"),
    )
    first = lambda c: F.try_element_at(c, F.lit(1))
    h264 = first(F.col("video_codecs")) == "h264"
    return found.select(
        *group, "containers", "video_codecs", "audio_codecs",
        first(F.col("containers")).alias("container"), first(F.col("video_codecs")).alias("video_codec"), first(F.col("audio_codecs")).alias("audio_codec"),
        F.when(h264, F.col("min_profile")).alias("max_profile"), F.when(h264, F.col("min_level")).alias("max_level"),
        "max_fps", F.col("size.width").alias("max_width"), F.col("size.height").alias("max_height"), "max_video_bitrate", "max_audio_bitrate",
    )


def plan_outputs(inputs: DataFrame, resolved: DataFrame) -> DataFrame:
    """For each input (container, video_codec, audio_codec, video_bitrate, audio_bitrate) the output plan.

    ``resolved``: the one row of ``resolve``.  What all devices play stays as it is.
    """
    r = F.broadcast(resolved.select(*(F.col(c).alias(f"r_{c}") for c in resolved.columns)))  # one row
    joined = inputs.join(r, F.lit(True), "left")
    keep = lambda own, every, other: F.when(F.array_contains(every, F.col(own)), F.col(own)).otherwise(F.col(other))
    planned = joined.select(
        *(F.col(c) for c in inputs.columns),
        keep("container", F.col("r_containers"), "r_container").alias("target_container"),
        keep("video_codec", F.col("r_video_codecs"), "r_video_codec").alias("target_video_codec"),
        keep("audio_codec", F.col("r_audio_codecs"), "r_audio_codec").alias("target_audio_codec"),
        target_bitrate(F.col("video_bitrate"), F.col("r_max_video_bitrate")).alias("target_video_bitrate"),
        target_bitrate(F.col("audio_bitrate"), F.col("r_max_audio_bitrate")).alias("target_audio_bitrate"),
        F.col("r_max_fps").alias("max_fps"), F.col("r_max_width").alias("max_width"), F.col("r_max_height").alias("max_height"),
        "r_max_profile", "r_max_level",
    )
    h264 = F.col("target_video_codec") == "h264"
    return planned.withColumn("max_profile", F.when(h264, F.col("r_max_profile"))).withColumn("max_level", F.when(h264, F.col("r_max_level"))).drop("r_max_profile", "r_max_level")


def plays(profile: dict[str, Column], device: dict[str, Column]) -> Column:
    """Whether a device plays a profile; a limit that either side lacks passes."""
    within = lambda key: F.coalesce(profile[key] <= device[key], F.lit(True))
    listed = F.array_contains(device["containers"], profile["container"]) & F.array_contains(device["video_codecs"], profile["video_codec"]) & F.array_contains(device["audio_codecs"], profile["audio_codec"])
    for key in ("max_profile", "max_level", "max_fps", "max_width", "max_height", "max_video_bitrate", "max_audio_bitrate"):
        listed = listed & within(key)
    return listed


#: Devices that are kept beside each profile as one value.
MOST_DEVICES = 10_000


def playable_everywhere(profiles: DataFrame, devices: DataFrame, key: str) -> DataFrame:
    """(key, n_devices, everywhere): on how many devices, and whether on all.

    A device table of up to ``MOST_DEVICES`` is one array that a profile is held against within its row;
    a larger one is joined by container, and the counts summed.
    """
    names = list(devices.columns)
    total = devices.count()
    profile = {c: F.col(c) for c in profiles.columns}
    if total <= MOST_DEVICES:
        listed = F.broadcast(devices.agg(F.collect_list(F.struct(*names)).alias("_devices")))  # one row
        n = F.size(F.filter("_devices", lambda d: plays(profile, {c: d[c] for c in names})))
        counted = profiles.join(listed, F.lit(True), "left").groupBy(key).agg(F.sum(n).cast("long").alias("n_devices"), F.bool_and(n == total).alias("everywhere"))
        return counted
    d = devices.select(*(F.col(c).alias(f"d_{c}") for c in names)).withColumn("d_container", F.explode("d_containers"))
    joined = profiles.join(d, F.col("container") == F.col("d_container"), "left")
    ok = plays(profile, {c: F.col(f"d_{c}") for c in names})
    return joined.groupBy(key).agg(F.count_if(ok).alias("n_devices")).withColumn("everywhere", F.col("n_devices") == total)


def supported_by_all(devices: DataFrame, codec_column: str) -> DataFrame:
    """(codec, n, everywhere): how many devices support each codec."""
    total = devices.agg(F.count("*").alias("total"))
    counts = devices.select(F.explode(codec_column).alias("codec"), "model").groupBy("codec").agg(F.countDistinct("model").alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("codec", "n", (F.col("n") == F.col("total")).alias("everywhere"))
