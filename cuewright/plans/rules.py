"""Queries of settings, media arithmetic, machine choices, rasters, writers and text rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import recognition as Q
from ..functions import repair
from ..functions import text as T
from ..operators import cues, evaluation, frames, hardware, telemetry
from ..sources import landing, sinks, subtitles
from .stand_ins import CUES_SQL, table
from .stand_ins import cues as cue_frame


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of many shapes, made from parts."""
    n = F.col("p_partkey").cast("string")
    ids = F.expr("case p_partkey % 4 when 0 then concat(p_partkey, '|', p_size, ',x;7') when 1 then ' ' when 2 then 'none' end")
    own = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # narrow rows, much work a row
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return own.select(
        "p_partkey", joined(T.env_ids(ids, F.lit("5 6"))).alias("env_ids"), joined(T.device_ids(F.concat(F.lit("3, x,1,"), (F.col("p_size") % 5).cast("string"), F.lit(",-2,3")))).alias("device_ids"),
        F.array_join(landing.first_paths(F.expr("case when p_partkey % 2 = 0 then ' | ' end"), F.concat(F.lit("/a/"), n, F.lit(" | |/b"))), ",").alias("paths"), T.redacted(F.expr("case when p_partkey % 2 = 0 then 'My_API_KEY' else 'path' end"), n).alias("shown"),
        T.boolish(F.expr("case p_partkey % 5 when 0 then 'YES' when 1 then '0' when 2 then 'n' when 3 then 'true' else 'maybe' end")).alias("flag"), T.pairs(F.concat(F.lit("Eng = a ,=x,fra="), n, F.lit(",eng=b,c")))["fra"].alias("pair"), T.pairs(F.lit("Eng = a ,=x,eng=b"))["eng"].alias("first_pair"),
        T.system_language(F.expr("case when p_partkey % 2 = 0 then '' end"), F.expr("case when p_size % 2 = 0 then 'de_DE.UTF-8@euro' end"), F.lit("C")).alias("system"), T.script_subtag(F.expr("case when p_size % 2 = 0 then 'zh-Hant-TW' else 'en-US' end")).alias("script"),
        landing.dispatch(F.expr("case p_partkey % 3 when 0 then ' Download' when 1 then 'TEST' else 'Rename' end")).getField("step").alias("step"), landing.dispatch(F.expr("case p_partkey % 3 when 0 then ' Download' when 1 then 'TEST' else 'Rename' end")).getField("reason").alias("reason"),
        T.described_bitrate(F.expr("case when p_size % 2 = 0 then p_size end")).alias("rate"), T.described_size(F.expr("case when p_size % 2 = 0 then p_size end"), F.lit(720)).alias("size"), T.described_codec(F.expr("case p_size % 3 when 0 then 'hevc' when 1 then 'xyz' end")).alias("codec"),
        T.joined_path(F.lit("/root//"), F.expr("case when p_size % 2 = 0 then '/abs' else 'rel/x' end")).alias("joined"), T.base_name(F.concat(F.lit("/x/y"), n, F.lit("//"))).alias("base"), T.cooldown_key(F.lit("tv"), F.lit("episode"), F.col("p_partkey")).alias("key"),
    )


SETTINGS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || ',' || p_size || ',7' ELSE '5,6' END AS env_ids, CASE p_size % 5 WHEN 0 THEN '0,1,3' WHEN 2 THEN '1,2,3' WHEN 4 THEN '1,3,4' ELSE '1,3' END AS device_ids, '/a/' || p_partkey || ',/b' AS paths,
  CASE WHEN p_partkey % 2 = 0 THEN '***' ELSE p_partkey::VARCHAR END AS shown, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS flag, p_partkey::VARCHAR AS pair, 'a' AS first_pair, CASE WHEN p_size % 2 = 0 THEN 'de_DE' ELSE 'C' END AS system, CASE WHEN p_size % 2 = 0 THEN 'hant' END AS script,
  CASE p_partkey % 3 WHEN 0 THEN 'plan' ELSE 'skip' END AS step, CASE p_partkey % 3 WHEN 1 THEN 'test event' WHEN 2 THEN 'event Rename' END AS reason, CASE WHEN p_size % 2 = 0 THEN p_size || ' bps' ELSE 'match source' END AS rate, CASE WHEN p_size % 2 = 0 THEN 'max ' || p_size || 'x720' ELSE 'match source' END AS size,
  CASE p_size % 3 WHEN 0 THEN 'HEVC' WHEN 1 THEN 'xyz' ELSE 'unknown' END AS codec, CASE WHEN p_size % 2 = 0 THEN '/abs' ELSE '/root/rel/x' END AS joined, 'y' || p_partkey AS base, 'tv:episode:' || p_partkey AS key FROM part"""


def download_plans(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "part").select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.expr("case when p_size % 2 = 0 then '.mkv' else '' end")).alias("path"))
    return landing.download_plan(paths, "tv").withColumn("kind", F.lit("tv")).unionByName(landing.download_plan(paths, "movie", suffix="x").withColumn("kind", F.lit("movie"))).unionByName(landing.download_plan(paths, "movie", given=["a", "b"]).withColumn("kind", F.lit("given")))


DOWNLOAD_PLANS = """WITH p AS (SELECT '/m/' || p_partkey AS stem, CASE WHEN p_size % 2 = 0 THEN '.mkv' ELSE '' END AS ext FROM part)
SELECT stem || ext AS path, stem || '.fixed' || ext AS target, 'tv' AS kind FROM p UNION ALL SELECT stem || ext, stem || '.x' || ext, 'movie' FROM p"""


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Quality tiers, names and containers of files."""
    own = table(spark, sf, "part")
    tier = F.expr("case p_partkey % 4 when 0 then ' UHD ' when 1 then 'source' when 2 then 'nonsense' end")
    height = F.expr("case p_size % 3 when 0 then 720 when 1 then 1080 else 700 end")
    demuxer, ext = F.expr("case p_size % 4 when 0 then 'mov,mp4,m4a,3gp' when 1 then 'matroska,webm' when 2 then 'mpegts' else 'avi' end"), F.expr("case p_partkey % 3 when 0 then 'M4V' when 1 then 'mov' else 'mp4' end")
    return own.select(
        "p_partkey", M.name_tier(tier, height).alias("tier"), M.tier(F.expr("case p_size % 2 when 0 then 'Studio' else 'cd' end"), M.AUDIO_ALIASES).alias("audio"), M.container_of(demuxer, ext).alias("container"), M.subtitle_codec(F.col("p_size") % 2 == 0, M.container_of(demuxer, ext)).alias("subtitle"),
        M.resolution_of(F.expr("case p_size % 2 when 0 then 1280 else 111 end"), F.lit(720)).alias("resolution"), M.profile_name(F.expr("case p_size % 3 when 0 then 100 when 1 then 77 else 5 end")).alias("profile"), M.level_name(F.expr("case p_size % 3 when 0 then 41 when 1 then 40 else 43 end")).alias("level"),
    )


FILE_NAMES = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '2160p' ELSE CASE p_size % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' ELSE 'match-source' END END AS tier, CASE p_size % 2 WHEN 0 THEN '320k' ELSE '192k' END AS audio,
  CASE p_size % 4 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'm4v' WHEN 1 THEN 'mov' ELSE 'mp4' END WHEN 1 THEN 'mkv' WHEN 2 THEN 'ts' END AS container, CASE WHEN p_size % 4 = 1 THEN 'subrip' ELSE 'mov_text' END AS subtitle,
  CASE p_size % 2 WHEN 0 THEN '720p' ELSE '1080p' END AS resolution, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'main' END AS profile, CASE p_size % 3 WHEN 0 THEN '4.1' WHEN 1 THEN '4' END AS level FROM part"""


def media_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Time bases, rates, lengths, boxes and colours from line items."""
    li = table(spark, sf, "lineitem").select("*", F.expr("l_linenumber * 10000000L + l_partkey").alias("line"))
    num = F.expr("case l_linenumber when 1 then 0 when 2 then 24000 else 30000 end")
    box = lambda a: F.struct(F.lit(a).alias("left"), F.lit(a).alias("top"), (F.col("l_linenumber") * 10).alias("right"), F.lit(40).alias("bottom"))
    rgb = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    base = M.time_base(num, F.lit(1001), F.lit(1), F.expr("case l_partkey % 2 when 0 then 1000 else 25 end"))
    span = M.temporal(F.expr("case when l_linenumber % 2 = 0 then 10.0D end"), F.lit(20.0), F.expr("case when l_linenumber % 3 = 0 then 25.0D end"), F.col("l_partkey"))
    source, output = F.struct(F.lit(100.0).alias("seconds"), F.lit(25.0).alias("fps")), F.struct((90.0 + F.col("l_linenumber") - 2).alias("seconds"), (F.col("l_linenumber") * 4.0).alias("fps"))
    cue = cues.interval(F.col("l_partkey") - 500, F.lit(100), F.expr("case when l_linenumber = 1 then 50 else 900 end"), F.col("l_suppkey") * 100)
    canvas = M.canvas(F.expr("case l_linenumber % 2 when 0 then 'dvd_subtitle' else 'subrip' end"), F.expr("case when l_linenumber < 4 then 0 else 720 end"), F.lit(480), F.lit(640), F.col("l_suppkey"), F.lit(None).cast("int"), F.lit(1080))
    return li.select(
        "l_orderkey", "line", M.rescaled(F.expr("l_partkey - 100"), F.lit(1), F.lit(90000), F.lit(1), F.lit(1000)).alias("ms"), F.round(M.frame_rate(M.rational(num, F.lit(1001)), F.col("l_quantity").cast("double") * 10), 4).alias("fps"),
        base["num"].alias("base_num"), base["den"].alias("base_den"), span["seconds"].alias("seconds"), F.round(span["fps"], 4).alias("span_fps"), M.rate_collapsed(source, output).alias("collapsed"), cue["start_ms"].cast("long").alias("start_ms"), cue["end_ms"].cast("long").alias("end_ms"),
        canvas["width"].alias("width"), canvas["height"].alias("height"), F.round(M.overlap_union(box(0), box(20)), 6).alias("iou"), M.box_area(box(20)).alias("area"), F.round(M.colour_distance(rgb(F.col("l_linenumber"), F.lit(0), F.lit(0)), rgb(F.lit(0), F.lit(4), F.lit(0))), 6).alias("distance"),
        M.luma(F.col("l_linenumber"), F.lit(100), F.lit(50)).alias("luma"),
    )


MEDIA_ARITHMETIC = """WITH l AS (SELECT *, l_linenumber::BIGINT * 10000000 + l_partkey AS line, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 24000 ELSE 30000 END AS num, greatest(l_partkey - 400, 0) AS s, greatest(l_partkey - 500 + CASE WHEN l_linenumber = 1 THEN 50 ELSE 900 END, greatest(l_partkey - 400, 0)) AS e, l_linenumber * 10 AS r FROM lineitem)
SELECT l_orderkey, line, CAST(round((l_partkey - 100) / 90.0) AS BIGINT) AS ms, CASE WHEN num > 0 THEN round(num / 1001.0::DOUBLE, 4) WHEN l_quantity * 10 <= 300 THEN round(l_quantity * 10.0::DOUBLE, 4) END AS fps, CASE WHEN num > 0 THEN 1001 WHEN l_partkey % 2 = 0 THEN 1001 ELSE 1 END AS base_num, CASE WHEN num > 0 THEN num WHEN l_partkey % 2 = 0 THEN 24000 ELSE 25 END AS base_den,
  CASE WHEN l_linenumber % 2 = 0 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS seconds, CASE WHEN l_linenumber % 3 = 0 THEN 25.0::DOUBLE WHEN l_partkey > 0 THEN round(l_partkey / CASE WHEN l_linenumber % 2 = 0 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END, 4) END AS span_fps, l_linenumber >= 2 AND l_linenumber * 4 < 20 AS collapsed, s::BIGINT AS start_ms,
  CASE WHEN e > s THEN e ELSE s + greatest(l_suppkey * 100, 1000) END::BIGINT AS end_ms, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber < 4 THEN 640 WHEN l_linenumber < 4 THEN 0 ELSE 720 END AS width, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber < 4 THEN greatest(l_suppkey, 1080) ELSE 480 END AS height,
  CASE WHEN r <= 20 THEN 0.0::DOUBLE ELSE round((r - 20) * 20.0::DOUBLE / (r * 40), 6) END AS iou, greatest(r - 20, 0) * 20 AS area, round(sqrt(l_linenumber * l_linenumber + 16.0::DOUBLE), 6) AS distance, (77 * l_linenumber + 15000 + 1450) >> 8 AS luma FROM l"""


def machine_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Backends, recognisers, providers and workers for machines made from suppliers."""
    s = table(spark, sf, "supplier")
    odd = lambda n: F.expr(f"s_suppkey % {n} = 1")
    requested = F.expr("case s_suppkey % 3 when 0 then 'auto' when 1 then 'cuda' else 'software' end")
    resize = hardware.resize_backend(requested, F.expr("s_suppkey % 5 <> 0"), {"device": odd(2), "filter": F.expr("s_suppkey % 7 <> 0")})
    engine = hardware.recogniser(odd(2), odd(4))
    plan = lambda need: F.array_join(hardware.provider_plan({"cuda": odd(2), "directml": odd(3), "coreml": F.lit(None).cast("boolean")}, need), ",")
    return s.select(
        "s_suppkey", resize["backend"].alias("backend"), F.array_join(resize["missing"], ",").alias("missing"), engine.alias("engine"),
        hardware.recogniser_choice(F.expr("case s_suppkey % 3 when 0 then 'fr-FR' end"), F.lit("de"), F.lit("en"), F.array(F.lit("eng"), F.lit("fra")), engine).alias("language"), plan(F.lit(False)).alias("providers"), plan(odd(5)).alias("gpu_providers"),
        hardware.fallback(F.expr("case when s_suppkey % 2 = 0 then 'latin' end"), F.expr("case when s_suppkey % 3 = 0 then 'cjk' end")).alias("fallback"),
        hardware.worker_plan(F.col("s_suppkey") % 11, F.lit(6), F.expr("case when s_suppkey % 2 = 0 then 4 end"), F.col("s_suppkey") % 3, F.lit(3)).cast("int").alias("workers"),
    )


MACHINE_CHOICES = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 1 AS gpu FROM supplier), r AS (SELECT *, k % 5 <> 0 AS resized, gpu AND k % 7 <> 0 AS ready, CASE WHEN NOT gpu THEN 'tesseract' WHEN k % 4 = 1 THEN 'ppocr-v3' ELSE 'ppocr-v4' END AS engine, concat_ws(',', CASE WHEN gpu THEN 'cuda' END, CASE WHEN k % 3 = 1 THEN 'directml' END) AS usable,
  CASE WHEN k % 3 > 0 THEN (k % 3) * 3 ELSE 6 END AS slots FROM s)
SELECT k AS s_suppkey, CASE WHEN NOT resized OR k % 3 = 2 THEN 'software' WHEN ready THEN 'cuda' WHEN k % 3 = 0 THEN 'software' END AS backend, CASE WHEN resized AND k % 3 <> 2 THEN concat_ws(',', CASE WHEN NOT gpu THEN 'device' END, CASE WHEN k % 7 = 0 THEN 'filter' END) ELSE '' END AS missing, engine,
  CASE WHEN engine = 'tesseract' THEN CASE WHEN k % 3 = 0 THEN 'fra' ELSE 'eng' END WHEN k % 3 = 0 THEN 'fra' ELSE 'deu' END AS language, concat_ws(',', nullif(usable, ''), 'cpu') AS providers, CASE WHEN k % 5 = 1 THEN nullif(usable, '') ELSE concat_ws(',', nullif(usable, ''), 'cpu') END AS gpu_providers,
  CASE WHEN k % 2 = 0 THEN 'latin' WHEN k % 3 = 0 THEN 'cjk' ELSE 'english' END AS fallback, greatest(least(slots, CASE WHEN k % 2 = 0 THEN 4 ELSE slots END, k % 11), 1)::INT AS workers FROM r"""


def encoder_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Encoders with the devices they need, the first that can be used by each customer, and hardware codecs."""
    n = table(spark, sf, "nation")
    encoders = n.select(F.concat(F.expr("case n_nationkey % 3 when 0 then 'h264_nvenc' when 1 then 'libx264' else 'hevc_vaapi' end"), F.lit("_"), F.col("n_nationkey").cast("string")).alias("name"), F.expr("case when n_nationkey % 4 = 0 then 'audio' else 'video' end").alias("kind"), F.expr("n_nationkey % 5 <> 0").alias("present"), F.array(F.col("n_regionkey"), F.col("n_regionkey") + 1).alias("needs"), F.col("n_nationkey").alias("ord"))
    devices = table(spark, sf, "region").select(F.col("r_regionkey").alias("device"), F.expr("r_regionkey in (1, 4)").alias("usable"))
    available = hardware.available_encoders(encoders, devices)
    first = hardware.first_choice(hardware.inventory(encoders, only_video=True).join(available, "name"), F.col("available"), "hardware")
    return available.join(first.select("name", F.col("hardware").alias("first_of")), "name", "left").join(hardware.inventory(encoders, only_video=True, only_hardware=True).select("name", "hardware"), "name", "left")


ENCODER_INVENTORY = """WITH e AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'h264_nvenc' WHEN 1 THEN 'libx264' ELSE 'hevc_vaapi' END || '_' || n_nationkey AS name, n_nationkey AS k, n_nationkey % 4 <> 0 AS video, n_nationkey % 3 <> 1 AS hw, n_nationkey % 5 <> 0 AND (n_regionkey IN (1, 4) OR n_regionkey + 1 IN (1, 4)) AS available FROM nation),
f AS (SELECT arg_min(name, k) AS name, hw FROM e WHERE video AND available GROUP BY hw)
SELECT e.name, available, f.hw AS first_of, CASE WHEN video AND e.hw THEN true END AS hardware FROM e LEFT JOIN f ON e.name = f.name"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The recognition candidate that is kept: a later one must be clearly better (three a part)."""
    own = table(spark, sf, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), q.alias("quality"), F.lit(f"c{k}").alias("name")) for k, q in ((0, F.col("p_size") % 10 / 10), (1, F.col("p_size") % 7 / 10), (2, F.col("p_partkey") % 10 / 10))))).alias("c")).select("p_partkey", "c.*")
    return hardware.best_candidate(own, 0.05, "p_partkey").select("p_partkey", "name", F.round("quality", 3).alias("quality"))


CANDIDATES = """WITH p AS (SELECT p_partkey, p_size % 10 AS a, p_size % 7 AS b, p_partkey % 10 AS c FROM part), s AS (SELECT *, CASE WHEN b > a THEN b ELSE a END AS ab, CASE WHEN b > a THEN 'c1' ELSE 'c0' END AS nab FROM p)
SELECT p_partkey, CASE WHEN c > ab THEN 'c2' ELSE nab END AS name, round(CASE WHEN c > ab THEN c ELSE ab END / 10.0, 3)::DOUBLE AS quality FROM s"""


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and counts in run logs of customers, subtitle codecs, and tracks with too few spaces."""
    li = table(spark, sf, "lineitem")
    lines = li.select(F.col("l_suppkey").alias("run"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"), F.expr("case l_linenumber % 3 when 0 then concat('tess_score=', l_linenumber / 10, ' ppocr_conf=0.5') when 1 then concat('ppocr_score=', l_linenumber / 10) else concat('found ', l_orderkey, ' streams and ', l_linenumber, ' cues') end").alias("line"))
    codecs = telemetry.codec_counts(li.select(F.lit("subtitle").alias("kind"), F.expr("case l_partkey % 3 when 0 then 'dvd_subtitle' else 'subrip' end").alias("codec")), M.BITMAP_SUBTITLES)
    summary = telemetry.run_summary(lines, "run")
    metrics = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), F.expr("case when s_suppkey % 2 = 0 then 'eng' else 'fra' end").alias("language"), (F.col("s_suppkey") * 10).alias("char_count"), (F.col("s_suppkey") % 10 / 100).alias("space_rate"))
    gated = telemetry.spacing_gate(metrics, 0.05).select("run", F.lit(True).alias("glued"))
    rounded = summary.select("run", *(F.round(c, 6).alias(c) for c in ("tess_score", "ppocr_score", "ppocr_conf")), "streams", "cues")
    return rounded.join(gated, "run", "left").crossJoin(F.broadcast(codecs.filter("bitmap").select(F.col("n").alias("bitmap_streams"))))


RUN_LOGS = """WITH l AS (SELECT l_suppkey AS run, l_orderkey::BIGINT * 10 + l_linenumber AS ord, l_linenumber % 3 AS k, l_linenumber AS n, l_orderkey AS o FROM lineitem)
SELECT run, round(avg(n / 10.0) FILTER (k = 0), 6)::DOUBLE AS tess_score, round(avg(n / 10.0) FILTER (k = 1), 6)::DOUBLE AS ppocr_score, round(avg(0.5) FILTER (k = 0), 6)::DOUBLE AS ppocr_conf, arg_max(o, ord) FILTER (k = 2) AS streams, arg_max(n, ord) FILTER (k = 2) AS cues,
  CASE WHEN run % 2 = 0 AND run * 10 >= 120 AND run % 10 < 5 THEN true END AS glued, (SELECT count(*) FROM lineitem WHERE l_partkey % 3 = 0) AS bitmap_streams FROM l GROUP BY run"""


def gpu_readings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select(F.expr("case when event_id % 10 = 0 then 'short,line' else concat('t, ', user_id % 4, ' ,', event_id % 101, ', x,', event_id % 7, ',', event_id % 9, ', 55 ') end").alias("value"))
    return telemetry.gpu_summary(landing.gpu_readings(lines))


GPU_READINGS = """WITH s AS (SELECT user_id % 4 AS gpu, (event_id % 101)::DOUBLE AS v FROM events WHERE event_id % 10 <> 0), o AS (SELECT gpu, list(v ORDER BY v) AS l FROM s GROUP BY gpu)
SELECT gpu::INT AS gpu, len(l) AS n, round(list_avg(l), 2) AS mean, round(list_median(l), 2) AS median, round(l[greatest(1, CAST(floor(len(l) * 0.95) AS BIGINT))], 2) AS p95, round(list_max(l), 2) AS max FROM o"""


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of inked rows and the spans of columns in them: events as pixels of users' images."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("image_id"), (F.col("event_id") % 97).alias("y")).distinct().withColumn("ink", F.expr("y % 9 < 6"))
    bands = cues.ink_runs(rows, least=2)
    columns = e.select(F.col("user_id").alias("image_id"), (F.col("event_id") % 89).alias("x")).distinct().withColumn("ink", F.expr("x % 11 <> 0"))
    spans = cues.column_spans(columns, band=["image_id"], gap=F.lit(4))
    total = lambda df, a, b, name: df.groupBy("image_id").agg(F.count("*").alias(f"{name}s"), F.sum(F.col(b) - F.col(a)).alias(f"{name}_size"))
    return total(bands, "top", "bottom", "band").join(total(spans, "left", "right", "span"), "image_id", "full")


RASTERS = """WITH y AS (SELECT DISTINCT user_id AS image_id, event_id % 97 AS y FROM events WHERE (event_id % 97) % 9 < 6), i AS (SELECT *, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM y),
b AS (SELECT image_id, g, max(y) - min(y) + 1 AS n FROM i GROUP BY ALL HAVING max(y) - min(y) + 1 >= 2), bs AS (SELECT image_id, count(*) AS bands, sum(n)::BIGINT AS band_size FROM b GROUP BY image_id),
x AS (SELECT DISTINCT user_id AS image_id, event_id % 89 AS x FROM events WHERE (event_id % 89) % 11 <> 0), m AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image_id ORDER BY x) > 4 THEN 1 ELSE 0 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS s FROM m),
c AS (SELECT image_id, s, max(x) - min(x) + 1 AS n FROM r GROUP BY ALL), cs AS (SELECT image_id, count(*) AS spans, sum(n)::BIGINT AS span_size FROM c GROUP BY image_id)
SELECT coalesce(bs.image_id, cs.image_id) AS image_id, bands, band_size, spans, span_size FROM bs FULL JOIN cs ON bs.image_id = cs.image_id"""


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines put together from word crops: the line items of an order, in two rows, those of flag R unread."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    top, left = (F.col("k") % 2 * 100).cast("int"), (F.floor(F.col("k") / 2) * 100 + F.when(F.col("k") % 4 == 2, -55).otherwise(0)).cast("int")
    crops = table(spark, sf, "lineitem").withColumn("k", place).select(F.col("l_orderkey").alias("cue_id"), left.alias("left"), top.alias("top"), (left + 40).alias("right"), (top + 20).alias("bottom"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat(F.lit("w"), F.col("k").cast("string"))).alias("text"), (F.col("k") / 10).alias("score"))
    return cues.word_crops(crops).select("cue_id", "line", "text", F.round("score", 6).alias("score"), "left", "right")


WORD_LINES = """WITH n AS (SELECT l_orderkey AS cue_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k, l_returnflag <> 'R' AS read FROM lineitem),
f AS (SELECT cue_id FROM n GROUP BY cue_id HAVING count(*) BETWEEN 2 AND 80 AND count(*) FILTER (read) >= 2),
w AS (SELECT cue_id, k, k % 2 AS row, k // 2 * 100 + CASE WHEN k % 4 = 2 THEN -55 ELSE 0 END AS l FROM n JOIN f USING (cue_id) WHERE read),
g AS (SELECT *, lag(l) OVER (PARTITION BY cue_id, row ORDER BY l) AS before FROM w), t AS (SELECT cue_id, row, string_agg(CASE WHEN before IS NULL THEN '' WHEN l - (before + 40) > 5 THEN ' ' ELSE '' END || 'w' || k, '' ORDER BY l) AS text, round(avg(k / 10.0), 6)::DOUBLE AS score, min(l)::INT AS "left", max(l)::INT + 40 AS "right" FROM g GROUP BY ALL)
SELECT cue_id, (row_number() OVER (PARTITION BY cue_id ORDER BY row) - 1)::INT AS line, text, score, "left", "right" FROM t"""


def frame_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles, streams to read again and files that lost frames."""
    li = table(spark, sf, "lineitem")
    rects = frames.rect_counts(li.select(F.col("l_suppkey").alias("stream_id"), F.expr("case when l_returnflag = 'R' then 'bitmap' else 'text' end").alias("kind")))
    retry = frames.retry_streams(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stream_id"), F.expr("s_suppkey % 2").alias("cues"), F.expr("s_suppkey % 3").alias("packets"), F.expr("s_suppkey % 4 - 2").alias("decoded"), F.expr("case s_suppkey % 5 when 0 then 'subrip' else 'xsub' end").alias("codec")), M.BITMAP_SUBTITLES).select("stream_id", F.lit(True).alias("again"))
    span = lambda s, f: F.struct(s.cast("double").alias("seconds"), f.cast("double").alias("fps"))
    collapsed = frames.temporal_collapse(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stream_id"), span(F.lit(100), F.expr("case when s_suppkey % 6 = 0 then 5 else 24 end")).alias("source"), span(F.lit(95), F.col("s_suppkey") % 30).alias("output"))).select("stream_id", "collapsed")
    return rects.join(retry, "stream_id", "left").join(collapsed, "stream_id", "left")


FRAME_CHECKS = """WITH r AS (SELECT l_suppkey AS stream_id, count(*) AS rects, count(*) FILTER (l_returnflag = 'R') AS bitmap_rects FROM lineitem GROUP BY 1)
SELECT stream_id, rects, bitmap_rects, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 4 = 2 AND s_suppkey % 5 <> 0 THEN true END AS again, s_suppkey % 6 <> 0 AND (s_suppkey % 30) / 24.0 < 0.8 AS collapsed FROM r LEFT JOIN supplier ON s_suppkey = stream_id"""


def zipped_cues(spark: SparkSession, sf: str) -> DataFrame:
    own = cue_frame(spark, sf)
    pairs = cues.zip_by_order(own.filter("ord % 2 = 0"), own.filter("ord % 2 = 1"))
    return pairs.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("ref_text") == F.col("hyp_text")).alias("equal"))


ZIPPED_CUES = f"""WITH {CUES_SQL}, n AS (SELECT track_id, ord % 2 AS side, text, row_number() OVER (PARTITION BY track_id, ord % 2 ORDER BY ord) AS place FROM cues)
SELECT a.track_id, count(*) AS n, count(*) FILTER (a.text = b.text) AS equal FROM n a JOIN n b ON a.track_id = b.track_id AND a.place = b.place AND a.side = 0 AND b.side = 1 GROUP BY a.track_id"""


def ass_digests(spark: SparkSession, sf: str) -> DataFrame:
    own = cue_frame(spark, sf).withColumn("text", F.concat("text", F.lit("{x}\\\r\ny")))
    return subtitles.ass_text(own).select("track_id", F.md5(F.encode(F.substring_index("text", "Effect, Text\n", -1), "UTF-8")).alias("digest"), F.contains("text", F.lit("PlayResX: 1920\n")).alias("sized"))


_ASS_TIME = lambda c: f"format('{{{{:d}}}}:{{{{:02d}}}}:{{{{:02d}}}}.{{{{:02d}}}}', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} // 10 % 100)".replace("{{", "{").replace("}}", "}")
ASS_DIGESTS = f"""WITH {CUES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, ord) AS n FROM cues)
SELECT track_id, md5(string_agg('Dialogue: 0,' || {_ASS_TIME("start_ms")} || ',' || {_ASS_TIME("end_ms")} || ',Default,,0,0,0,,' || text || '\\{{x\\}}\\\\\\Ny' || chr(10), '' ORDER BY n)) AS digest, true AS sized FROM n GROUP BY track_id"""


def sample_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Crops that may train a recogniser: names of parts as lines, types as rectangles of manufacturers' images."""
    box = lambda a, b: F.struct(F.lit(2).alias("left"), F.lit(1).alias("top"), a.alias("right"), b.alias("bottom"))
    part = table(spark, sf, "part")
    rows = lambda kind, text: part.select(F.expr("p_partkey % 10").alias("image_id"), F.lit("eng").alias("language"), F.lit(kind).alias("kind"), text.alias("text"), box(F.col("p_size"), F.lit(20)).alias("bbox"))
    lines = rows("line", F.when(F.col("p_partkey") % 10 < 5, F.concat(F.lit("we go home "), F.col("p_size").cast("string"))).otherwise(F.lit("abcdefghijklmnopq"))).unionByName(rows("rect", F.concat(F.lit("they stay "), F.col("p_size").cast("string"))))
    made = sinks.training_samples(lines, "line")
    return made.groupBy("image_id", "kind").agg(F.count("*").alias("n"), F.sum("bbox.left").alias("left"), F.sum("bbox.right").alias("right")).withColumn("listed", F.lit(sinks.sample_manifest(made).count()))


SAMPLE_EXPORTS = """WITH p AS (SELECT p_partkey % 10 AS image_id, p_size FROM part), m AS (SELECT DISTINCT CASE WHEN image_id < 5 THEN 'line' ELSE 'rect' END, p_size FROM p)
SELECT image_id, CASE WHEN image_id < 5 THEN 'line' ELSE 'rect' END AS kind, count(*) AS n, CASE WHEN image_id < 5 THEN 0 ELSE 2 * count(*) END::BIGINT AS left, sum(CASE WHEN image_id < 5 THEN p_size + 3 ELSE p_size END)::BIGINT AS right, (SELECT count(*)::INT FROM m) AS listed FROM p GROUP BY image_id"""


def label_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Validation lines: the fixed ones and as many more as asked for, no text on both sides."""
    labels = table(spark, sf, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("text"), F.expr("case p_partkey % 20 when 0 then true when 1 then null else false end").alias("flag"))
    split = sinks.split_labels(labels, seed=7, validation=F.col("flag"), val_count=50)
    return split.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("flag") & (F.col("split") == "train")).alias("lost"), F.count_if(F.col("flag").isNull()).alias("unflagged"), F.countDistinct("text", "split").alias("texts"))


LABEL_SPLITS = "SELECT count(*) AS n, greatest(50, count(*) FILTER (p_partkey % 20 = 0)) AS val, 0::BIGINT AS lost, count(*) FILTER (p_partkey % 20 = 1) AS unflagged, count(*) AS texts FROM part"


def mode_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.expr("case p_size % 2 when 0 then 'pure' else 'hybrid' end").alias("mode"), F.expr("case p_partkey % 2 when 0 then 'eng' else 'fra' end").alias("language"), F.lit(0.5).alias("cer"), F.lit(0.25).alias("wer"), F.lit(0.75).alias("similarity"), F.lit(True).alias("meets_threshold"), F.lit(1.0).alias("infer_ms"), F.lit(False).alias("used_fallback"))
    return sinks.report_markdown(evaluation.summarise_modes(rows))


MODE_REPORT = """WITH c AS (SELECT CASE p_size % 2 WHEN 0 THEN 'pure' ELSE 'hybrid' END AS mode, count(*) AS n, count(*) FILTER (p_partkey % 2 = 0) AS e FROM part GROUP BY 1), r AS (SELECT mode, unnest(['all', 'eng', 'fra']) AS language, unnest([n, e, n - e]) AS n FROM c)
SELECT mode, '## ' || mode || chr(10) || chr(10) || '| language | n | CER | WER | similarity | pass rate |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || string_agg('| ' || language || ' | ' || n || ' | 0.5000 | 0.2500 | 0.7500 | 1.0000 |', chr(10) ORDER BY language) AS markdown FROM r WHERE n > 0 GROUP BY mode"""


#: Texts and what becomes of them, by rule; the expected ones were written down, not computed.
CASES = {
    "confusion": [("he11o w0rld", "hello world"), ("the 12th of May", "the 12th of May"), ("the l2th", "the 12th"), ("|'m here", "I'm here"), ("vve go", "we go"), ("wouId", "would"), ("wiII", "wiiI"), ("wiIIing", "wiiling"), ("pIace sIeep", "piace sieep"), ("fQn", "fun"), ("runN RunN NO", "runn RunN NO"), ("5tay 18 21st", "stay 18 2lst")],
    "punctuation": [("Well,then.Go", "Well, then. Go"), ("3.14", "3.14"), ("a:b;c!d?e", "a: b; c! d? e")],
    "digits": [("abc123def", "abc 123 def"), ("21st and 3rd", "21st and 3rd"), ("4x4", "4 x 4")],
    "quote": [('say"Hello"now', 'say "Hello "now'), ('say "Hi" now', 'say "Hi" now'), ('"a"', '"a"')],
    "fragments": [("I fell a sleep", "I fell asleep"), ("So on enough", "Soon enough"), ("could n't", "couldn't"), ("Yo u go", "You go"), ("a sleeping", "a sleeping")],
    "ass_strip": [(r"Dialogue: 0,0,0,Default,{\i1}Hi{\i0}\Nyou ", "Hi\nyou"), ("plain", "plain")],
    "ass_fonts": [(r"{\fs20\fscx90\fnArial\b1}x", r"{\b1}x"), (r"\fs-1.5y", "y")],
    "colour": [("&H0000FF&", "255,0,0"), ("&H102030&", "48,32,16"), ("nonsense", None)],
    "spoken": [("21st", "21st"), ("", "")],
    "bits": [("1.5M", "1500000"), ("320 kbps", "320000"), ("x", None)],
    "evaluation": [("“Hi”  …\tok ", '"Hi" ... ok')],
}


def _ruled(name: str, text: Column) -> Column:
    rgb = T.rgb_of_ass(text)
    rules = {
        "confusion": repair.unconfused_text, "punctuation": T.space_after_punctuation, "digits": T.space_letters_digits, "quote": T.space_before_quote, "fragments": repair.unfragmented, "ass_strip": T.ass_text, "ass_fonts": T.strip_font_overrides,
        "colour": lambda _: F.when(rgb.isNotNull(), F.concat_ws(",", rgb["r"], rgb["g"], rgb["b"])), "spoken": T.normalise_lines, "bits": lambda c: T.bits_per_second(c).cast("string"), "evaluation": T.evaluation_text,
    }
    return rules[name](text)


def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule's cases, each once a nation."""
    cases = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(was).alias("was")) for rule, own in CASES.items() for was, _ in own))
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(cases).alias("c")).select("n_nationkey", "c.rule", "c.was")
    made = F.lit(None).cast("string")
    for rule in CASES:
        made = F.when(F.col("rule") == rule, _ruled(rule, F.col("was"))).otherwise(made)
    return rows.withColumn("now", made)


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


TEXT_RULES = "SELECT n_nationkey, rule, was, now FROM nation, (VALUES " + ", ".join(f"('{rule}', {_quoted(was)}, {_quoted(now)})" for rule, own in CASES.items() for was, now in own) + ") v(rule, was, now)"

#: Glued and confused words, what a small lexicon makes of them, and texts as a whole.
LEXICON = repair.Lexicon(frozenset("the cat sat on mat with you they will not now here we are going home said very old friend think thing".split()), frozenset(["th", "he", "in", "er", "an"]), frozenset(["the", "ing"]))
REPAIRS = [
    ("thecatsat", "the cat sat"), ("They'llnot go", "They'll not go"), ("thecat said \"now", "the cat said \"now"), ("WeAre", "We Are"), ("old fhing wifh Fhe", "old thing with The"), ("th eycat Sat", "they cat Sat"), ("th eycat sat", "th eycat sat"), ("thecat satO n themat.", "the cat sato n the mat."), ("theyarehere.Now", "they are here. Now"), ("plain text", "plain text"), ("the 21st cat", "the 2 lst cat"), ("the l2th cat", "the 12th cat"),
]


def glued_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whole repair of English lines, and of French ones, which stay as they are."""
    lexicon = spark.sparkContext.broadcast(LEXICON)
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(was) for was, _ in REPAIRS))).alias("was"), F.lit("eng").alias("language"))
    rows = rows.unionByName(rows.withColumn("language", F.lit("fra")))
    return rows.withColumn("now", repair.postprocess(lexicon, F.col("was"), F.col("language")))


GLUED_WORDS = "SELECT n_nationkey, was, language, CASE language WHEN 'eng' THEN now ELSE was END AS now FROM nation, (VALUES " + ", ".join(f"({_quoted(was)}, {_quoted(now)})" for was, now in REPAIRS) + ") v(was, now), (VALUES ('eng'), ('fra')) l(language)"

#: Recognised lines (text, right edge, bottom edge, score) and what the rules say: spacing, geometry and residual fallback.
LINES = {
    "clean": ([("we are going home", 100, 20, 0.9), ("said the old friend", 100, 20, 0.8)], (False, False, False)),
    "glued": ([("wearegoinghomenow", 100, 20, 0.9)], (True, False, True)),
    "tall": ([("hello there", 10, 90, 0.9)], (False, True, False)),
    "camel": ([("we are goingHome now", 100, 20, None)], (False, False, True)),
    "empty": ([], (False, False, False)),
}


def recognised_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Fallback rules, pruning and confidence over recognised lines."""
    kind = "array<struct<text:string,bbox:struct<left:int,top:int,right:int,bottom:int>,score:double>>"
    listed = [F.struct(F.lit(name).alias("name"), (F.array(*(F.struct(F.lit(t).alias("text"), F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(r).alias("right"), F.lit(b).alias("bottom")).alias("bbox"), F.lit(s).cast("double").alias("score")) for t, r, b, s in lines)) if lines else F.array()).cast(kind).alias("lines")) for name, (lines, _) in LINES.items()]
    rows = table(spark, sf, "region").select("r_regionkey", F.explode(F.array(*listed)).alias("c")).select("r_regionkey", "c.*")
    texts = F.transform("lines", lambda x: x["text"])
    pruned = Q.pruned(F.col("lines"), F.lit("eng"))
    return rows.select(
        "r_regionkey", "name", Q.spacing_fallback(F.col("lines")).alias("spacing"), Q.geometry_fallback(F.col("lines"), F.lit("eng")).alias("geometry"), Q.residual_fallback(texts, F.lit("eng")).alias("residual"), (F.size("lines") > 0).alias("some"),
        pruned["dropped"].alias("dropped"), F.round(Q.confidence(F.col("lines")), 6).alias("confidence"), Q.joined_lines(F.col("lines")).alias("joined"), Q.recovery_taken(Q.quality_after(texts, F.lit("eng")), F.lit(0.5)).alias("recovered"),
    )


RECOGNISED_LINES = """SELECT r_regionkey, v.* FROM region, (VALUES ('clean', false, false, false, true, 0, 0.85::DOUBLE, 'we are going home said the old friend', true), ('glued', true, false, true, true, 0, 0.9, 'wearegoinghomenow', false),
  ('tall', false, true, false, true, 1, 0.9, 'hello there', true), ('camel', false, false, true, true, 0, NULL, 'we are goingHome now', true), ('empty', false, false, false, false, 0, NULL, '', false)) v(name, spacing, geometry, residual, "some", dropped, confidence, joined, recovered)"""


QUERIES = {
    "settings": (settings, SETTINGS),
    "download_plans": (download_plans, DOWNLOAD_PLANS),
    "file_names": (file_names, FILE_NAMES),
    "media_arithmetic": (media_arithmetic, MEDIA_ARITHMETIC),
    "machine_choices": (machine_choices, MACHINE_CHOICES),
    "encoder_inventory": (encoder_inventory, ENCODER_INVENTORY),
    "candidate_choice": (candidates, CANDIDATES),
    "run_logs": (run_logs, RUN_LOGS),
    "gpu_readings": (gpu_readings, GPU_READINGS),
    "rasters": (rasters, RASTERS),
    "word_lines": (word_lines, WORD_LINES),
    "frame_checks": (frame_checks, FRAME_CHECKS),
    "zipped_cues": (zipped_cues, ZIPPED_CUES),
    "ass_digests": (ass_digests, ASS_DIGESTS),
    "sample_exports": (sample_exports, SAMPLE_EXPORTS),
    "label_splits": (label_splits, LABEL_SPLITS),
    "mode_report": (mode_report, MODE_REPORT),
    "text_rules": (text_rules, TEXT_RULES),
    "glued_words": (glued_words, GLUED_WORDS),
    "recognised_lines": (recognised_lines, RECOGNISED_LINES),
}
