"""Queries over paged answers and packet streams that come in parts."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import landing, paged
from ..sources.images import write_images
from ..sources.replace import Journal
from ..streaming import demux
from .flows import _folder, in_parts
from .stand_ins import table

MIN_DAY = 9000


def _page_files(spark: SparkSession, sf: str) -> str:
    """Orders as the history of twenty servers, newest first, a hundred records a page; every seventh record has no date."""
    o, root = table(spark, sf, "orders"), f"{_folder(spark)}/pages-{uuid.uuid4().hex}"
    source = F.col("o_custkey") % 20
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("o_orderdate").desc(), "o_orderkey")) - 1
    record = F.struct(
        F.col("o_orderkey").alias("id"), F.when(source % 2 == 0, F.col("o_custkey")).alias("episodeId"), F.when(source % 2 == 1, F.struct(F.col("o_custkey").alias("id"))).alias("movie"),
        F.expr("case o_orderstatus when 'F' then 'downloadFolderImported' else 'grabbed' end").alias("eventType"), F.when(F.expr("o_orderkey % 7 <> 0"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
    )
    placed = o.withColumn("source", source).withColumn("place", place).select("source", F.floor(F.col("place") / 100 + 1).cast("int").alias("page"), F.struct("place", record.alias("record")).alias("r"))
    bodies = placed.groupBy("source", "page").agg(F.to_json(F.struct(F.array_sort(F.collect_list("r"))["record"].alias("records"))).alias("value"))
    bodies.write.partitionBy("source", "page").text(root)
    return root


def paged_history(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of the days asked for, with how many pages of their server were opened."""
    root = _page_files(spark, sf)
    raw = paged.paged(spark, root, min_day=MIN_DAY, max_pages=0).select("source", "page", F.parse_json("record").alias("v"))
    opened = paged.paged(spark, root, min_day=MIN_DAY, max_pages=0, report=True)
    kinds = []
    for kind, rest in (("tv", 0), ("movie", 1)):
        own = raw.filter(F.col("source").cast("int") % 2 == rest)
        kinds.append(landing.history(own, kind, MIN_DAY, keep=("source", "page")))
    made = kinds[0].unionByName(kinds[1]).join(opened.drop("stopped"), "source")  # a row a server
    return made.select("source", "page", "opened", "id", "kind", "item_id", "day")


PAGED_HISTORY = f"""WITH h AS (SELECT o_custkey % 20 AS s, o_orderkey AS id, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END::INT AS day,
  ((row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey) - 1) // 100 + 1)::INT AS page FROM orders),
t AS (SELECT s, coalesce(min(page) FILTER (day < {MIN_DAY}), max(page)) AS opened FROM h GROUP BY s)
SELECT s::VARCHAR AS source, page, opened, id, CASE WHEN s % 2 = 0 THEN 'tv' ELSE 'movie' END AS kind, o_custkey AS item_id, day
FROM h JOIN t USING (s) WHERE page <= opened AND o_orderstatus = 'F' AND (day IS NULL OR day >= {MIN_DAY})"""


def stream_demux(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the packets of twenty files with four streams each, in three parts; streams that no supplier stands for drop.

    A last packet a year later, of a file of its own, lets the watermark pass all ends.
    """
    events, s = table(spark, sf, "events"), table(spark, sf, "supplier")
    stream = F.floor(F.col("s_suppkey") / 20).cast("int") % 4
    contexts = s.select((F.col("s_suppkey") % 20).alias("file_id"), stream.alias("stream"), F.element_at(F.array(*map(F.lit, ("video", "audio", "subtitle", "attachment"))), stream + 1).alias("kind")).distinct()
    packets = lambda e: e.select(
        F.when(F.col("user_id") >= 0, F.col("user_id") % 20).otherwise(F.col("user_id")).alias("file_id"), (F.col("event_id") % 4).cast("int").alias("stream"), F.col("event_id").alias("ord"), (F.col("event_id") % 97).alias("dts"),
        (F.col("event_id") % 101).alias("pts"), (F.col("event_id") % 700).alias("samples"), (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("at"),
    )
    own = contexts.unionByName(spark.createDataFrame([(-1, 0, "attachment")], contexts.schema))  # of the last packet
    routed = lambda e: packets(e).join(F.broadcast(own) if own.count() <= 100_000 else own, ["file_id", "stream"])
    most = events.agg(F.max("event_id").alias("m")).first().m or 0
    last = events.orderBy(F.col("event_id").desc()).limit(1).withColumns({"event_id": F.lit(0).cast("long"), "user_id": F.lit(-1).cast("long"), "ts": F.expr("ts + interval 366 days")}).select(*events.columns)
    out = in_parts(spark, sf, lambda e: demux.demuxed(routed(e), gap=timedelta(days=60)), F.floor(F.col("event_id") * 3 / (most + 1)), 3, last)
    return out.filter("file_id >= 0")


STREAM_DEMUX = """WITH c AS (SELECT DISTINCT s_suppkey % 20 AS file_id, ((s_suppkey // 20) % 4)::INT AS stream FROM supplier),
p AS (SELECT file_id, stream, event_id AS ord, event_id % 97 AS dts, event_id % 101 AS pts, event_id % 700 AS samples, event_type = 'error' AS failed, row_number() OVER (PARTITION BY file_id, stream ORDER BY event_id) AS i
  FROM (SELECT *, user_id % 20 AS file_id, (event_id % 4)::INT AS stream FROM events) JOIN c USING (file_id, stream)),
v AS (SELECT *, i + max(dts - i) OVER (PARTITION BY file_id ORDER BY ord) AS new_dts FROM p WHERE stream = 0),
a AS (SELECT file_id, sum(samples) AS total FROM p WHERE stream = 1 GROUP BY file_id),
f AS (SELECT file_id, total, unnest(range(0, (total + 1023)::BIGINT // 1024)) AS n FROM a),
s AS (SELECT *, coalesce(sum(failed::INT) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE stream = 2),
e AS (SELECT file_id, count(*) AS taken FROM (SELECT file_id FROM p WHERE stream < 2 UNION ALL SELECT file_id FROM s WHERE before = 0) GROUP BY file_id)
SELECT file_id, stream, 'video' AS kind, 'write' AS step, ord AS n, new_dts AS dts, CASE WHEN new_dts > dts THEN greatest(pts, new_dts) ELSE pts END AS pts, NULL::BIGINT AS size FROM v
UNION ALL SELECT file_id, 1, 'audio', CASE WHEN total - n * 1024 < 1024 THEN 'flush' ELSE 'write' END, n, n * 1024, n * 1024, least(1024, total - n * 1024)::BIGINT FROM f
UNION ALL SELECT file_id, 2, 'subtitle', CASE WHEN failed THEN 'skip' ELSE 'write' END, ord, dts, pts, NULL FROM s WHERE before = 0
UNION ALL SELECT file_id, NULL, 'file', 'end', coalesce(taken, 0), NULL, NULL, n - coalesce(taken, 0) FROM (SELECT file_id, count(*) AS n FROM p GROUP BY file_id) LEFT JOIN e USING (file_id)"""


def replace_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' files put in place of others, in place or beside, stopped at two steps and recovered twice."""
    k, root = F.col("s_suppkey"), f"{_folder(spark)}/replace-{uuid.uuid4().hex}"
    at = lambda kind: F.concat(F.lit(f"{root}/files/"), k.cast("string"), F.lit(f".{kind}"))
    s = table(spark, sf, "supplier")
    old = s.filter("s_suppkey % 7 <> 0").select(F.concat(k.cast("string"), F.lit(".in")).alias("name"), F.concat(F.lit("old "), "s_name").cast("binary").alias("content"))
    new = s.filter("s_suppkey % 6 <> 1").select(F.concat(k.cast("string"), F.lit(".temp")).alias("name"), F.concat(F.lit("new "), "s_name").cast("binary").alias("content"))
    write_images(old.unionByName(new), f"{root}/files")
    journal = Journal(spark, f"{root}/journal")
    journal.plan(s.select(k.alias("plan_id"), at("in").alias("input"), at("temp").alias("temp"), F.when(k % 2 == 0, at("in")).otherwise(at("out")).alias("final"), at("backup").alias("backup")))
    journal.move()
    journal.promote(F.col("plan_id") % 6 != 2)  # these never came so far
    journal.finish(F.col("plan_id") % 6 != 3)
    journal.recover()
    Journal(spark, f"{root}/journal").recover()
    found = spark.read.format("binaryFile").load(f"{root}/files").select(F.regexp_extract("path", r"/([0-9]+)\.[a-z]+$", 1).cast("long").alias("plan_id"), F.struct(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), F.col("content").cast("string").alias("text")).alias("f"))
    left = found.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["kind"], F.lit(": "), f["text"])), ", ").alias("files"))
    return journal.states().join(left, "plan_id", "left").select(F.col("plan_id").alias("s_suppkey"), "state", "files")


REPLACE_PLANS = """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'refused' WHEN 2 THEN 'rolled back' ELSE 'done' END AS state,
  CASE WHEN s_suppkey % 6 NOT IN (1, 2) THEN CASE WHEN s_suppkey % 2 = 0 THEN 'in' ELSE 'out' END || ': new ' || s_name WHEN s_suppkey % 7 <> 0 THEN 'in: old ' || s_name END AS files FROM supplier"""


QUERIES = {
    "paged_history": (paged_history, PAGED_HISTORY),
    "stream_demux": (stream_demux, STREAM_DEMUX),
    "replace_plans": (replace_plans, REPLACE_PLANS),
}
