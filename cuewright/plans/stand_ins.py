"""The driver's tables read as media records, in Spark and, word for word, in SQL.

The driver has no media tables, so each operator runs on columns that take their part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that plays today: 2024-02-01.
TODAY = 19754
NOW = TODAY * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as download-queue items."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.lit("tv").alias("kind"),
        F.col("user_id").alias("item_id"),
        F.expr("case when event_type in ('purchase', 'click') then 'completed' when event_type = 'view' then 'downloading' else 'queued' end").alias("status"),
        F.expr("case when event_type not in ('purchase', 'click') then 'downloading' when user_id % 3 = 0 then 'importPending' when user_id % 3 = 1 then 'importBlocked' else 'imported' end").alias("state"),
        F.expr("case when event_type = 'click' then 'warning' else 'ok' end").alias("tracked"),
        F.expr("case when user_id % 2 = 0 then 'torrent' else 'usenet' end").alias("protocol"),
        F.expr("case when event_id % 5 < 2 then 0 else event_id % 1000 end").alias("size"),
        F.lit(0).cast("long").alias("left"),
        F.date_format("ts", "yyyy-MM-dd").alias("added"),
        F.expr("case event_id % 4 when 0 then 'Invalid Season or Episode' when 1 then 'Episode wasn''t requested' when 2 then 'fine' end").alias("error"),
        F.lit(None).cast("array<struct<title:string,messages:array<string>>>").alias("messages"),
    )


QUEUE_SQL = """queue AS (
  SELECT event_id AS id, user_id AS item_id,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'completed' WHEN event_type = 'view' THEN 'downloading' ELSE 'queued' END AS status,
    CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'downloading' WHEN user_id % 3 = 0 THEN 'importPending' WHEN user_id % 3 = 1 THEN 'importBlocked' ELSE 'imported' END AS state,
    CASE WHEN event_type = 'click' THEN 'warning' ELSE 'ok' END AS tracked,
    CASE WHEN user_id % 2 = 0 THEN 'torrent' ELSE 'usenet' END AS protocol,
    CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 1000 END AS size,
    date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
    CASE event_id % 4 WHEN 0 THEN 'invalid season or episode' WHEN 1 THEN 'episode wasn''t requested' WHEN 2 THEN 'fine' END AS text
  FROM events
), reasoned AS (
  SELECT *, CASE
    WHEN status = 'queued' AND state = 'downloading' AND tracked = 'ok' AND protocol = 'torrent' AND size = 0 AND 19754 - day >= 14 THEN 'stale zero-size torrent queue item'
    WHEN NOT (status = 'completed' AND tracked = 'warning') THEN NULL
    WHEN text = 'invalid season or episode' THEN 'invalid season or episode'
    WHEN text = 'episode wasn''t requested' THEN 'episode mismatch or multi-episode pack' END AS reason
  FROM queue
)"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as release candidates of parts."""
    yes = lambda c: F.expr(c)
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("Show.S01E"), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(F.col("l_returnflag") == "R", "torrent").otherwise("usenet").alias("protocol"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("eng"), F.lit("jpn"))).otherwise(F.array(F.lit("jpn"))).alias("languages"),
        none.alias("subtitle_languages"),
        F.when(yes("l_linenumber % 3 = 0"), F.array(F.lit("Dual Dub"))).otherwise(none).alias("custom_formats"),
        F.col("l_quantity").cast("long").alias("custom_format_score"),
        F.col("l_linenumber").cast("long").alias("quality_weight"),
        (F.col("l_returnflag") == "A").alias("rejected"),
        F.when(yes("l_linenumber % 2 = 0"), F.array(F.lit("Existing file meets cutoff"))).otherwise(F.array(F.lit("Wrong quality"))).alias("rejections"),
        F.lit(None).cast("boolean").alias("download_allowed"),
        F.lit(None).cast("string").alias("release_type"),
        F.lit(None).cast("array<bigint>").alias("mapped_ids"),
        F.lit(None).cast("array<bigint>").alias("episode_ids"),
        F.lit(None).cast("bigint").alias("episode_id"),
        F.lit(None).cast("array<bigint>").alias("episode_numbers"),
        F.lit(None).cast("array<bigint>").alias("absolute_numbers"),
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the streams of orders: the first is the video, flag R is a subtitle, the others audio."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.expr("case when l_orderkey % 4 = 0 then 'mkv' else 'mp4' end").alias("container"),
        F.expr("((l_linenumber * 10000000L + l_partkey) * 10000L + l_suppkey) * 100L + cast(l_quantity as bigint)").alias("index"),
        F.expr("case when l_linenumber in (1, 4) then 'video' when l_returnflag = 'R' then 'subtitle' else 'audio' end").alias("kind"),
        F.expr("case when l_linenumber in (1, 4) then case when l_partkey % 5 = 0 then 'hevc' else 'h264' end when l_returnflag = 'R' then case when l_partkey % 2 = 0 then 'subrip' else 'dvd_subtitle' end else case when l_partkey % 3 = 0 then 'ac3' else 'aac' end end").alias("codec"),
        F.expr("cast(l_quantity * 80 as int)").alias("width"),
        F.expr("cast(l_quantity * 45 as int)").alias("height"),
        F.expr("cast(l_extendedprice * 200 as bigint)").alias("bitrate"),
        F.expr("cast(20 + l_linenumber * 6 as double)").alias("fps"),
        F.expr("case when l_suppkey % 7 = 0 then 110 else 100 end").alias("profile"),
        F.expr("case l_suppkey % 4 when 0 then 31 when 1 then 40 when 2 then 41 else 51 end").alias("level"),
        F.lit(False).alias("attached_picture"),
    )


STREAMS_SQL = """streams AS (
  SELECT l_orderkey AS file_id, CASE WHEN l_orderkey % 4 = 0 THEN 'mkv' ELSE 'mp4' END AS container, ((l_linenumber::BIGINT * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(trunc(l_quantity) AS BIGINT) AS index,
    CASE WHEN l_linenumber IN (1, 4) THEN 'video' WHEN l_returnflag = 'R' THEN 'subtitle' ELSE 'audio' END AS kind,
    CASE WHEN l_linenumber IN (1, 4) THEN CASE WHEN l_partkey % 5 = 0 THEN 'hevc' ELSE 'h264' END
      WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 2 = 0 THEN 'subrip' ELSE 'dvd_subtitle' END
      ELSE CASE WHEN l_partkey % 3 = 0 THEN 'ac3' ELSE 'aac' END END AS codec,
    CAST(trunc(l_quantity * 80) AS INT) AS width, CAST(trunc(l_quantity * 45) AS INT) AS height, CAST(trunc(l_extendedprice * 200) AS BIGINT) AS bitrate,
    CAST(20 + l_linenumber * 6 AS DOUBLE) AS fps, CASE WHEN l_suppkey % 7 = 0 THEN 110 ELSE 100 END AS profile,
    CASE l_suppkey % 4 WHEN 0 THEN 31 WHEN 1 THEN 40 WHEN 2 THEN 41 ELSE 51 END AS level
  FROM lineitem
)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues of users, in order of time; they last event_id % 100 thousand seconds."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("ord"), start.alias("start_ms"), (start + (F.col("event_id") % 100) * 1_000_000).alias("end_ms"),
        F.expr("case when event_type = 'error' then ' ' else event_type end").alias("text"),
    )


CUES_SQL = """cues AS (
  SELECT user_id AS track_id, event_id AS ord, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + (event_id % 100) * 1000000 AS end_ms,
    CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text
  FROM events
)"""
