"""Queries of queues, audits, devices, files and frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import releases as R
from ..functions.text import language_tag, missing_text
from ..operators import assess, audit, devices, frames, queue
from .stand_ins import NOW, QUEUE_SQL, STREAMS_SQL, TODAY, releases, streams, table
from .stand_ins import queue as queue_frame


def queue_health(spark: SparkSession, sf: str) -> DataFrame:
    return queue.health(queue_frame(spark, sf), F.lit(TODAY), 14)


QUEUE_HEALTH = f"""WITH {QUEUE_SQL}
SELECT count(*) AS total,
  count(*) FILTER (status = 'completed' AND state = 'importPending') AS completed_import_pending,
  count(*) FILTER (status = 'completed' AND state = 'importBlocked') AS completed_import_blocked,
  count(*) FILTER (status = 'completed' AND tracked = 'warning') AS completed_warning,
  count(*) FILTER (protocol = 'torrent' AND size = 0 AND 19754 - day >= 14) AS stale_zero_size_torrents,
  count(*) FILTER (protocol = 'torrent' AND status = 'queued' AND state = 'downloading' AND size = 0) AS queued_zero_size_torrents,
  count(*) FILTER (protocol = 'torrent' AND status = 'queued' AND state = 'downloading' AND size <> 0) AS queued_nonzero_torrents,
  count(*) FILTER (protocol = 'torrent' AND status = 'downloading' AND state = 'downloading' AND size = 0) AS downloading_zero_size_torrents,
  count(*) FILTER (protocol = 'torrent' AND status = 'downloading' AND state = 'downloading' AND size <> 0) AS downloading_nonzero_torrents,
  count(*) FILTER (reason IN ('invalid season or episode', 'episode mismatch or multi-episode pack')) AS invalid_or_mismatch_warnings
FROM reasoned"""


def queue_removals(spark: SparkSession, sf: str) -> DataFrame:
    return queue.removals(queue_frame(spark, sf), F.lit(TODAY), 14, cap=25).select("id", "reason", "priority", "day")


QUEUE_REMOVALS = f"""WITH {QUEUE_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY reason ORDER BY day, id) AS place FROM reasoned WHERE reason IS NOT NULL)
SELECT id, reason, CASE WHEN reason LIKE 'stale%' THEN 10 ELSE 0 END AS priority, day FROM numbered WHERE reason NOT LIKE 'stale%' OR place <= 25"""


def stale_items(spark: SparkSession, sf: str) -> DataFrame:
    q = queue_frame(spark, sf)
    return q.filter(R.is_stale(F.col("added"), F.lit(TODAY), 20) & R.zero_size(F.col("size"), F.col("left"))).select("id", "item_id", R.day_number(F.col("added")).alias("day"))


STALE_ITEMS = f"WITH {QUEUE_SQL} SELECT id, item_id, day FROM queue WHERE size = 0 AND 19754 - day >= 20"


def latest_missing(spark: SparkSession, sf: str) -> DataFrame:
    open_ = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("item_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return audit.within_budget(open_, 50)


LATEST_MISSING = """SELECT o_orderkey AS item_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders
WHERE o_orderstatus = 'O' ORDER BY day DESC NULLS LAST, item_id DESC LIMIT 50"""


def latest_import(spark: SparkSession, sf: str) -> DataFrame:
    history = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), F.col("ts").alias("date"), "event_type")
    return audit.latest_import(history, wanted="purchase", depth=20)


LATEST_IMPORT = """WITH recent AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS place FROM events)
SELECT user_id AS item_id, arg_min(event_id, place) AS history_id FROM recent WHERE place <= 20 AND event_type = 'purchase' GROUP BY user_id"""


def not_queued(spark: SparkSession, sf: str) -> DataFrame:
    missing = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), "c_name")
    active = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("item_id"))
    return audit.not_queued(missing, active)


NOT_QUEUED = """SELECT c_custkey AS item_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"""


def cooldown_days(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "events").select(F.col("user_id").alias("item_id")).distinct()
    searched = table(spark, sf, "events").filter("event_type = 'error'").select(F.concat(F.lit("tv:item:"), F.col("user_id").cast("string")).alias("key"), F.lit("eng|").alias("requirements"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("checked_at"))
    return audit.cooled(items, searched, F.lit(NOW), 30, kind="tv", noun="item", requirements=F.lit("eng|"))


COOLDOWN_DAYS = f"""WITH last AS (SELECT user_id, max(epoch_us(ts) // 1000000) AS t0 FROM (SELECT user_id, ts FROM events WHERE event_type = 'error') GROUP BY user_id)
SELECT DISTINCT e.user_id AS item_id, CASE WHEN {NOW} - t0 >= 0 AND {NOW} - t0 < 30 * 86400 THEN ceil((30 * 86400 - ({NOW} - t0)) / 86400.0)::INT END AS days_left
FROM events e LEFT JOIN last l ON e.user_id = l.user_id"""


def best_release(spark: SparkSession, sf: str) -> DataFrame:
    best = audit.best_release(releases(spark, sf), ["eng", "jpn"], [], "strict", prefer_non_torrent=True, episodes=False)
    return best.select("item_id", F.col("release.ord").alias("ord"), R.score(F.col("release")).alias("score"))


BEST_RELEASE = """WITH r AS (SELECT l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS ord, l_returnflag <> 'R' AS direct, CAST(trunc(l_quantity) AS BIGINT) + l_linenumber AS score
  FROM lineitem WHERE l_linestatus = 'O' AND (l_returnflag <> 'A' OR l_linenumber % 2 = 0))
SELECT item_id, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY direct DESC, score DESC, ord DESC) AS place FROM r) WHERE place = 1"""


def hinted_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Policies that read names: how many releases pass each, and what speaks for them."""
    r = releases(spark, sf).select(F.struct("*").alias("release"))
    release = F.col("release")
    counts = [F.count_if(R.satisfies(release, ["eng"], [], p)).alias(p.replace("-", "_")) for p in R.POLICIES]
    return r.groupBy(R.evidence(release, ["eng"], "custom-format").alias("evidence")).agg(*counts)


HINTED_RELEASES = """WITH r AS (SELECT l_linestatus = 'O' AS eng, l_linenumber % 3 = 0 AS dub FROM lineitem)
SELECT 'release languages [' || CASE WHEN eng THEN 'eng, jpn' ELSE 'jpn' END || ']' || CASE WHEN dub THEN '; custom formats [dual dub]; custom-format audio hint' ELSE '' END AS evidence,
  count(*) FILTER (eng) AS strict, count(*) FILTER (dub) AS custom_format, count(*) FILTER (dub) AS custom_format_or_title, count(*) FILTER (dub) AS title_guess
FROM r GROUP BY eng, dub"""


def first_import(spark: SparkSession, sf: str) -> DataFrame:
    pending = table(spark, sf, "orders").select(F.col("o_orderkey").alias("download_id"), (F.col("o_orderstatus") == "F").alias("satisfied"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("download_id"), F.expr("l_linenumber * 10000000L + l_partkey").alias("ord"), "l_partkey", "l_returnflag")
    return audit.first_import(pending, items, F.col("l_returnflag") == "N").select("download_id", "item.ord", "item.l_partkey")


FIRST_IMPORT = """SELECT download_id, ord, l_partkey FROM (SELECT l_orderkey AS download_id, l_linenumber::BIGINT * 10000000 + l_partkey AS ord, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND o_orderstatus <> 'F') WHERE place = 1"""


def language_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's actions over the stand-ins: parts as files, releases from line items."""
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.unix_date(F.lit("2024-01-01").cast("date")).alias("day"), F.expr("case when p_size % 2 = 0 then 'Japanese' else 'English / Japanese' end").alias("info_audio"), F.lit("").alias("info_subtitles"), F.lit(None).cast("array<string>").alias("languages"))
    queued = table(spark, sf, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("item_id"))
    none = spark.createDataFrame([], "key string, requirements string, checked_at bigint")
    history = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("item_id"), F.lit("2024-01-01").alias("date"), F.lit("downloadFolderImported").alias("event_type"))
    actions, _ = audit.language_audit(files, queued, none, releases(spark, sf), history, audio=["eng", "jpn"], subtitles=[], policy="strict", now=F.lit(NOW), cooldown_days=30, budget=200, kind="movie", dry_run=False)
    return actions.select("item_id", "step", "action", F.col("release.ord").alias("ord"))


LANGUAGE_AUDIT = """WITH eligible AS (SELECT p_partkey AS item_id FROM part WHERE p_size % 2 = 0 AND p_partkey % 10 <> 3 ORDER BY p_partkey DESC LIMIT 200),
r AS (SELECT l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS ord, CAST(trunc(l_quantity) AS BIGINT) + l_linenumber AS score FROM lineitem WHERE l_linestatus = 'O' AND (l_returnflag <> 'A' OR l_linenumber % 2 = 0)),
best AS (SELECT item_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord DESC) AS place FROM r) WHERE place = 1),
s AS (SELECT e.item_id, b.ord, e.item_id % 4 = 0 AS known FROM eligible e LEFT JOIN best b ON e.item_id = b.item_id)
SELECT item_id, 0 AS step, CASE WHEN ord IS NULL THEN 'no-candidate' WHEN known THEN 'grab' ELSE 'refused' END AS action, ord FROM s
UNION ALL SELECT item_id, 1, 'mark-failed', ord FROM s WHERE ord IS NOT NULL AND known"""


def language_report(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of each source's documents against a requirement."""
    present = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set(language_tag(F.col("lang")))).alias("have"))
    own = present.withColumn("r", audit.report(F.col("have"), F.array().cast("array<string>"), ["eng", "jpn", "deu"], ["eng"]))
    return own.select("source", F.array_join("have", ",").alias("have"), F.array_join("r.missing_audio", ",").alias("missing_audio"), missing_text(F.col("r.missing_audio"), F.col("r.missing_subtitles")).alias("missing"))


LANGUAGE_REPORT = """WITH s AS (SELECT source, list_sort(list(DISTINCT CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END)) AS have FROM documents WHERE lang IS NOT NULL GROUP BY source),
m AS (SELECT source, have, list_filter(['eng', 'jpn', 'deu'], lambda x: NOT list_contains(have, x)) AS missing_list FROM s)
SELECT source, array_to_string(have, ',') AS have, array_to_string(missing_list, ',') AS missing_audio, 'audio [' || array_to_string(missing_list, ', ') || ']; subtitles [eng]' AS missing FROM m"""


def device_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = devices.resolve(devices.catalogue(spark))
    return r.select("container", "video_codec", "audio_codec", "max_profile", "max_level", "max_fps", "max_width", "max_height", "max_video_bitrate", "max_audio_bitrate")


DEVICE_PROFILE = """SELECT 'mp4' AS container, 'h264' AS video_codec, 'aac' AS audio_codec, 100 AS max_profile, 41 AS max_level, 30 AS max_fps, 1280 AS max_width, 720 AS max_height, CAST(12000000 AS BIGINT) AS max_video_bitrate, CAST(256000 AS BIGINT) AS max_audio_bitrate"""


def device_families(spark: SparkSession, sf: str) -> DataFrame:
    r = devices.resolve(devices.catalogue(spark), "family")
    return r.select("family", F.array_join("containers", ",").alias("containers"), F.array_join("video_codecs", ",").alias("video_codecs"), F.array_join("audio_codecs", ",").alias("audio_codecs"), "max_level", "max_fps", "max_height", "max_video_bitrate")


DEVICE_FAMILIES = """SELECT * FROM (VALUES
  ('apple_tv', 'mp4,m4v,mov', 'h264', 'aac,ac3,eac3', 42, 60, 1080, CAST(20000000 AS BIGINT)),
  ('chromecast', 'mp4', 'h264', 'aac', 41, 30, 720, 12000000),
  ('fire_tv', 'mp4,mkv', 'h264,hevc,av1', 'aac,ac3,eac3,flac', 51, 60, 2160, 35000000),
  ('roku', 'mp4,mkv', 'h264,hevc', 'aac,ac3,eac3,dts', 41, 60, 1080, 20000000)
) v(family, containers, video_codecs, audio_codecs, max_level, max_fps, max_height, max_video_bitrate)"""


def output_plans(spark: SparkSession, sf: str) -> DataFrame:
    inputs = table(spark, sf, "part").select(
        "p_partkey", F.expr("case p_size % 3 when 0 then 'mkv' when 1 then 'mp4' else 'avi' end").alias("container"), F.expr("case p_partkey % 3 when 0 then 'h264' when 1 then 'hevc' else 'vp9' end").alias("video_codec"),
        F.expr("case p_partkey % 2 when 0 then 'aac' else 'dts' end").alias("audio_codec"), F.expr("cast(p_retailprice * 10000 as bigint)").alias("video_bitrate"), F.expr("case when p_size > 25 then cast(p_size * 10000 as bigint) end").alias("audio_bitrate"),
    )
    roku = devices.resolve(devices.pick(devices.catalogue(spark), family="roku"))
    return devices.plan_outputs(inputs, roku).select("p_partkey", "target_container", "target_video_codec", "target_audio_codec", "target_video_bitrate", "target_audio_bitrate", "max_profile", "max_level")


OUTPUT_PLANS = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'mkv' ELSE 'mp4' END AS target_container, CASE p_partkey % 3 WHEN 1 THEN 'hevc' ELSE 'h264' END AS target_video_codec,
  CASE p_partkey % 2 WHEN 0 THEN 'aac' ELSE 'dts' END AS target_audio_codec, least(CAST(trunc(p_retailprice * 10000) AS BIGINT), 20000000) AS target_video_bitrate,
  CASE WHEN p_size > 25 THEN least(p_size * 10000, 640000) ELSE 640000 END::BIGINT AS target_audio_bitrate,
  CASE WHEN p_partkey % 3 <> 1 THEN 100 END AS max_profile, CASE WHEN p_partkey % 3 <> 1 THEN 41 END AS max_level FROM part"""


def playable(spark: SparkSession, sf: str) -> DataFrame:
    profiles = table(spark, sf, "part").select(
        "p_partkey", F.lit("mp4").alias("container"), F.lit("h264").alias("video_codec"), F.lit("aac").alias("audio_codec"), F.lit(100).alias("max_profile"), F.expr("case p_size % 4 when 0 then 40 when 1 then 41 when 2 then 42 else 51 end").alias("max_level"),
        F.expr("case p_partkey % 2 when 0 then 30 else 60 end").alias("max_fps"), F.expr("case p_size % 3 when 0 then 1280 when 1 then 1920 else 3840 end").alias("max_width"), F.expr("case p_size % 3 when 0 then 720 when 1 then 1080 else 2160 end").alias("max_height"),
        F.expr("cast(p_retailprice * 10000 as bigint)").alias("max_video_bitrate"), F.lit(None).cast("bigint").alias("max_audio_bitrate"),
    )
    return devices.playable_everywhere(profiles, devices.catalogue(spark), "p_partkey")


PLAYABLE = """WITH d(level, fps, height, rate) AS (VALUES (41, 30, 1080, 20), (41, 60, 1080, 20), (42, 60, 1080, 25), (42, 60, 2160, 35), (51, 60, 2160, 45), (52, 60, 2160, 45), (41, 60, 720, 12), (41, 30, 720, 12),
  (41, 60, 1080, 20), (51, 60, 2160, 40), (51, 60, 2160, 40), (42, 60, 1080, 20), (51, 60, 2160, 35), (51, 60, 2160, 40), (52, 60, 2160, 40), (51, 60, 2160, 35), (51, 60, 2160, 40), (52, 60, 2160, 40)),
j AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 40 WHEN 1 THEN 41 WHEN 2 THEN 42 ELSE 51 END <= level AND CASE p_partkey % 2 WHEN 0 THEN 30 ELSE 60 END <= fps AND CASE p_size % 3 WHEN 0 THEN 720 WHEN 1 THEN 1080 ELSE 2160 END <= height
  AND trunc(p_retailprice * 10000) <= rate * 1000000 AS ok FROM part, d)
SELECT p_partkey, count(*) FILTER (ok) AS n_devices, bool_and(ok) AS everywhere FROM j GROUP BY p_partkey"""


def codec_support(spark: SparkSession, sf: str) -> DataFrame:
    return devices.supported_by_all(devices.catalogue(spark), "video_codecs")


CODEC_SUPPORT = """SELECT * FROM (VALUES ('h264', CAST(18 AS BIGINT), true), ('hevc', 11, false), ('vp8', 2, false), ('vp9', 4, false), ('av1', 3, false)) v(codec, n, everywhere)"""


_TARGET = assess.Target("mp4", "h264", "aac", 100, 41, 60.0, 1920, 1080, 12_000_000, 8_000_000, 1280, 720)


def direct_play(spark: SparkSession, sf: str) -> DataFrame:
    return assess.direct_play(streams(spark, sf), _TARGET).select("file_id", F.array_join("reasons", "|").alias("reasons"), "compatible")


DIRECT_PLAY = f"""WITH {STREAMS_SQL}, r AS (SELECT file_id, index, container, array_to_string(list_filter([
    CASE WHEN kind = 'video' AND codec <> 'h264' THEN 'video codec' END,
    CASE WHEN kind = 'video' AND (width > 1920 OR height > 1080) THEN 'larger than the devices play' END,
    CASE WHEN kind = 'video' AND (width > 1280 OR height > 720) THEN 'larger than the quality' END,
    CASE WHEN kind = 'video' AND bitrate > 12000000 THEN 'video bit rate' END,
    CASE WHEN kind = 'video' AND fps > 60.5 THEN 'frame rate' END,
    CASE WHEN kind = 'video' AND codec = 'h264' AND profile > 100 THEN 'H.264 profile above limit' END,
    CASE WHEN kind = 'video' AND codec = 'h264' AND level > 41 THEN 'H.264 level above limit' END,
    CASE WHEN kind = 'audio' AND codec <> 'aac' THEN 'audio codec' END,
    CASE WHEN kind = 'audio' AND bitrate > 8000000 THEN 'audio bit rate' END,
    CASE WHEN kind = 'subtitle' AND codec = 'dvd_subtitle' THEN 'bitmap subtitles in mp4' END], lambda x: x IS NOT NULL), '|') AS own FROM streams),
g AS (SELECT file_id, CASE WHEN any_value(container) <> 'mp4' THEN 'container' ELSE '' END AS c, coalesce(string_agg(own, '|' ORDER BY index) FILTER (own <> ''), '') AS s FROM r GROUP BY file_id)
SELECT file_id, c || CASE WHEN c <> '' AND s <> '' THEN '|' ELSE '' END || s AS reasons, c = '' AND s = '' AS compatible FROM g"""


def primary_stream(spark: SparkSession, sf: str) -> DataFrame:
    own = streams(spark, sf)
    by = [assess.primary_video(own, c).withColumnRenamed("index", c) for c in ("resolution", "bitrate", "fps")]
    return by[0].join(by[1], "file_id").join(by[2], "file_id")


PRIMARY_STREAM = f"""WITH {STREAMS_SQL}, v AS (SELECT *, width::BIGINT * height AS area, floor(fps * 1000) AS rate FROM streams WHERE kind = 'video')
SELECT file_id, arg_max(index, (area, bitrate, -index)) AS resolution, arg_max(index, (bitrate, area, -index)) AS bitrate, arg_max(index, (rate, area, -index)) AS fps FROM v GROUP BY file_id"""


def output_errors(spark: SparkSession, sf: str) -> DataFrame:
    return assess.output_errors(streams(spark, sf), "h264", "aac").select("file_id", F.array_join("errors", "|").alias("errors"))


OUTPUT_ERRORS = f"""WITH {STREAMS_SQL}, f AS (SELECT file_id, coalesce(bool_or(kind = 'video' AND (width <= 0 OR height <= 0)), false) AS e, bool_or(kind = 'video' AND codec = 'h264') AS v, bool_or(kind = 'audio' AND codec = 'aac') AS a FROM streams GROUP BY file_id)
SELECT file_id, array_to_string(list_filter([CASE WHEN e THEN 'video without size' END, CASE WHEN NOT v THEN 'no video of the planned codec' END, CASE WHEN NOT a THEN 'no audio of the planned codec' END], lambda x: x IS NOT NULL), '|') AS errors FROM f"""


def profile_check(spark: SparkSession, sf: str) -> DataFrame:
    return assess.profile_check(streams(spark, sf), 100, 41).groupBy("verdict").agg(F.count("*").alias("n"))


PROFILE_CHECK = f"""WITH {STREAMS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY index) AS place FROM streams WHERE kind = 'video')
SELECT CASE WHEN codec = 'h264' AND profile = 100 AND level = 41 THEN 'verified' ELSE 'mismatch' END AS verdict, count(*) AS n FROM f WHERE place = 1 GROUP BY 1"""


def extra_video(spark: SparkSession, sf: str) -> DataFrame:
    own = streams(spark, sf)
    return assess.extra_video(own, assess.primary_video(own), "ignore").groupBy("outcome").agg(F.count("*").alias("n"))


EXTRA_VIDEO = f"""WITH {STREAMS_SQL}, v AS (SELECT count(*) AS n, count(DISTINCT file_id) AS f FROM streams WHERE kind = 'video') SELECT 'primary' AS outcome, f AS n FROM v UNION ALL SELECT 'drop', n - f FROM v WHERE n > f"""


def clamped_sizes(spark: SparkSession, sf: str) -> DataFrame:
    size = M.clamped_size(F.col("p_size") * 37 + 601, F.col("p_size") * 21 + 339, F.lit(1920), F.lit(1080))
    return table(spark, sf, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


CLAMPED_SIZES = """WITH p AS (SELECT p_partkey, p_size * 37 + 601 AS w, p_size * 21 + 339 AS h FROM part),
s AS (SELECT *, least(1920.0::DOUBLE / w, 1080.0::DOUBLE / h) AS k FROM p),
e AS (SELECT *, CAST(floor(w * k + 0.5) AS INT) AS rw, CAST(floor(h * k + 0.5) AS INT) AS rh FROM s),
g AS (SELECT *, rw - rw % 2 AS sw, rh - rh % 2 AS sh FROM e),
a AS (SELECT *, list_filter(list_transform(range(sw // 16, 0, -1), lambda m: {'width': CAST(m * 16 AS INT), 'height': CAST(floor(m * 16 / (w::DOUBLE / h) + 0.5) AS INT) + CAST(floor(m * 16 / (w::DOUBLE / h) + 0.5) AS INT) % 2}), lambda x: x.height <= 1080)[1] AS fit FROM g)
SELECT p_partkey, CASE WHEN w <= 1920 AND h <= 1080 THEN w - w % 2 WHEN sw % 16 <> 0 THEN fit.width ELSE sw END AS width, CASE WHEN w <= 1920 AND h <= 1080 THEN h - h % 2 WHEN sw % 16 <> 0 THEN fit.height ELSE sh END AS height FROM a"""


def presets(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("p_size") * 40, F.col("p_size") * 22
    own = table(spark, sf, "part").select(M.audio_preset(F.expr("cast(p_retailprice * 150 as bigint)")).alias("audio"), M.video_preset(w, h, F.expr("cast(p_retailprice * 20000 as bigint)")).alias("video"), M.video_bitrate_for(w, h).cast("long").alias("usual"))
    return own.groupBy("audio", "video", "usual").agg(F.count("*").alias("n"))


PRESETS = """WITH p AS (SELECT CAST(trunc(p_retailprice * 150) AS BIGINT) AS a, p_size * 40 AS w, CAST(trunc(p_retailprice * 20000) AS BIGINT) AS b FROM part),
r AS (SELECT (SELECT name FROM (VALUES (96000, '96k'), (128000, '128k'), (160000, '160k'), (192000, '192k'), (224000, '224k'), (256000, '256k'), (320000, '320k')) v(bps, name) ORDER BY abs(p.a - bps), bps LIMIT 1) AS audio,
  CASE WHEN w <= 360 THEN '360p' WHEN w <= 480 THEN '480p' WHEN w <= 720 THEN '720p' WHEN w <= 1080 THEN '1080p' WHEN w <= 1440 THEN '1440p' WHEN b >= 30000000 THEN '2160p' ELSE '1440p' END AS video,
  CASE WHEN w <= 640 THEN 1200000 WHEN w <= 854 THEN 2500000 WHEN w <= 1280 THEN 5000000 WHEN w <= 1920 THEN 8000000 WHEN w <= 2560 THEN 16000000 ELSE 35000000 END::BIGINT AS usual FROM p)
SELECT audio, video, usual, count(*) AS n FROM r GROUP BY ALL"""


def encoder_rates(spark: SparkSession, sf: str) -> DataFrame:
    level = F.expr("case p_size % 5 when 0 then 30 when 1 then 31 when 2 then 40 when 3 then 41 else 52 end")
    own = table(spark, sf, "part").select("p_partkey", M.level_name(level).alias("level"), M.encoder_rates(F.expr("cast(p_retailprice * 20000 as bigint)"), level).alias("r"))
    return own.select("p_partkey", "level", "r.rate", "r.peak", "r.buffer")


ENCODER_RATES = """WITH l(k, level, rate, buffer) AS (VALUES (0, '3', 12500000, 10000000), (1, '3.1', 17500000, 14000000), (2, '4', 25000000, 25000000), (3, '4.1', 62500000, 62500000), (4, '5.2', NULL, NULL)),
p AS (SELECT p_partkey, p_size % 5 AS k, CAST(trunc(p_retailprice * 20000) AS BIGINT) AS b FROM part)
SELECT p_partkey, level, least(b, coalesce(rate, b)) AS rate, least(b * 2, coalesce(rate, b * 2)) AS peak, least(b * 2, coalesce(buffer, b * 2)) AS buffer FROM p JOIN l USING (k)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("frame"), (F.col("event_id") % 251).cast("double").alias("luma_mean"), (F.col("event_id") % 60).cast("double").alias("luma_deviation"), (F.col("event_id") % 130).cast("double").alias("u_mean"), (F.col("event_id") % 128).cast("double").alias("v_mean"))


def visual_report(spark: SparkSession, sf: str) -> DataFrame:
    r = frames.visual_report(frames.sampled(_frames(spark, sf), first=120, interval=5), 0.3)
    return r.withColumn("avg_luma", F.round("avg_luma", 4)).select("file_id", "inspected", "suspicious", "solid", "avg_luma", "green_failure", "solid_failure")


VISUAL_REPORT = """WITH n AS (SELECT user_id AS file_id, event_id % 251 AS m, event_id % 60 AS d, event_id % 130 AS u, event_id % 128 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
c AS (SELECT file_id, count(*) AS inspected, count(*) FILTER (m > 25 AND d < 55 AND u < 100 AND v < 115 AND 256 - u - v > 45) AS suspicious, count(*) FILTER (m > 25 AND m < 235 AND d < 2.5) AS solid, round(avg(m), 4) AS avg_luma FROM n WHERE place < 120 AND place % 5 = 0 GROUP BY file_id)
SELECT *, inspected >= 3 AND suspicious >= greatest(ceil(inspected * 0.3), 2) AS green_failure, inspected >= 3 AND solid >= greatest(ceil(inspected * 0.3), 2) AS solid_failure FROM c"""


def dominant_colour(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("index"), (F.col("l_quantity") * 5).alias("alpha"))
    return frames.dominant_colour(pixels)


DOMINANT_COLOUR = """WITH c AS (SELECT l_partkey AS image_id, l_linenumber AS index, count(*) AS n FROM lineitem WHERE l_quantity * 5 > 16 GROUP BY ALL)
SELECT image_id, index, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, index) AS place FROM c) WHERE place = 1"""


def plane_statistics(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("plane"), (F.col("l_partkey") % 400).alias("x"), (F.col("l_orderkey") % 300).alias("y"), F.lit(400).alias("width"), F.lit(300).alias("height"), (F.col("l_quantity") * 5).alias("value"))
    s = frames.plane_statistics(pixels, plane=["plane"])
    return s.select("plane", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 3).alias("deviation"))


PLANE_STATISTICS = """SELECT l_suppkey AS plane, count(*) AS n, round(avg(l_quantity * 5), 4) AS mean, round(stddev_pop(l_quantity * 5), 3) AS deviation FROM lineitem
WHERE (l_partkey % 400) % 6 = 0 AND (l_orderkey % 300) % 6 = 0 GROUP BY l_suppkey"""


def occurrence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecar names: the n-th track of a language in a file."""
    from ..functions.text import sidecar_language
    from ..operators.cues import sidecar_paths

    tracks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("L."), F.col("l_returnflag")).alias("tag"))
    return sidecar_paths(tracks, stem=F.concat(F.lit("film"), F.col("file_id").cast("string")), language=sidecar_language(F.col("tag"))).select("file_id", "ord", "path")


OCCURRENCE_NUMBERS = """WITH n AS (SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem)
SELECT l_orderkey AS file_id, l_linenumber AS ord, 'film' || l_orderkey || '.l' || f || CASE WHEN n = 1 THEN '' ELSE '.' || n END || '.srt' AS path FROM n"""


def newest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.sinks import upsert

    rows = table(spark, sf, "events").select(F.concat(F.lit("tv:item:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("checked_at"), "event_type")
    return upsert(rows.filter("checked_at % 2 = 0"), rows.filter("checked_at % 2 = 1"), "key", "checked_at")


NEWEST_BY_KEY = "SELECT 'tv:item:' || user_id AS key, max(event_id) AS checked_at, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def rollups(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return made


ROLLUPS = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    ordered, all_ = table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    label = lambda df, name: df.select(F.lit(name).alias("of"), "key")
    return label(all_.intersect(ordered), "both").unionByName(label(all_.subtract(ordered), "never")).unionByName(label(ordered.exceptAll(all_), "repeats")).groupBy("of").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


KEY_SETS = """WITH x AS (SELECT 'both' AS of, key FROM (SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'never', key FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'repeats', key FROM (SELECT o_custkey AS key FROM orders EXCEPT ALL SELECT c_custkey FROM customer))
SELECT of, count(*) AS n, sum(key)::BIGINT AS total FROM x GROUP BY of"""


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


EVENT_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return own.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""


def join_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their lines: the large sides join by a shuffled hash, the dimension is left to Spark's size check."""
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    joined = li.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


JOIN_SHAPES = "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("place"), F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(w), 2).alias("ahead"), F.ntile(4).over(w).alias("quarter"))
    return ranked.filter("place <= 3")


RANKS = """SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER w AS place, round(o_totalprice - lead(o_totalprice) OVER w, 2) AS ahead, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE place <= 3"""


QUERIES = {
    "queue_health": (queue_health, QUEUE_HEALTH),
    "queue_removals": (queue_removals, QUEUE_REMOVALS),
    "stale_items": (stale_items, STALE_ITEMS),
    "latest_missing_topk": (latest_missing, LATEST_MISSING),
    "latest_import_per_item": (latest_import, LATEST_IMPORT),
    "active_queue_anti": (not_queued, NOT_QUEUED),
    "cooldown_days": (cooldown_days, COOLDOWN_DAYS),
    "best_release": (best_release, BEST_RELEASE),
    "hinted_releases": (hinted_releases, HINTED_RELEASES),
    "first_import_item": (first_import, FIRST_IMPORT),
    "language_audit": (language_audit, LANGUAGE_AUDIT),
    "lang_required_diff": (language_report, LANGUAGE_REPORT),
    "device_resolve_all": (device_profile, DEVICE_PROFILE),
    "device_families": (device_families, DEVICE_FAMILIES),
    "device_plan": (output_plans, OUTPUT_PLANS),
    "device_playable": (playable, PLAYABLE),
    "codec_support": (codec_support, CODEC_SUPPORT),
    "compat_reasons": (direct_play, DIRECT_PLAY),
    "primary_stream": (primary_stream, PRIMARY_STREAM),
    "output_errors": (output_errors, OUTPUT_ERRORS),
    "profile_check": (profile_check, PROFILE_CHECK),
    "extra_video": (extra_video, EXTRA_VIDEO),
    "clamp_dims": (clamped_sizes, CLAMPED_SIZES),
    "tier_lookup": (presets, PRESETS),
    "encoder_rates": (encoder_rates, ENCODER_RATES),
    "visual_report": (visual_report, VISUAL_REPORT),
    "dominant_colour": (dominant_colour, DOMINANT_COLOUR),
    "plane_statistics": (plane_statistics, PLANE_STATISTICS),
    "occurrence_numbers": (occurrence_numbers, OCCURRENCE_NUMBERS),
    "newest_by_key": (newest_by_key, NEWEST_BY_KEY),
    "cube_counts": (rollups, ROLLUPS),
    "key_sets": (key_sets, KEY_SETS),
    "event_windows": (event_windows, EVENT_WINDOWS),
    "sessions": (sessions, SESSIONS),
    "join_shapes": (join_shapes, JOIN_SHAPES),
    "rank_windows": (ranks, RANKS),
}
