"""Queries over files that Spark writes of the tables: cached records, logs, fixture pairs; and colours."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import landing
from ..sources.images import write_images
from .flows import _folder
from .stand_ins import table


def cached_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cache files of a hundred records each; every seventh file is cut short and gives none."""
    root = f"{_folder(spark)}/cache-{uuid.uuid4().hex}"
    record = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") * 86400).alias("checked_at"), F.col("c_mktsegment").alias("kind"))
    part = F.floor(F.col("c_custkey") / 100)
    whole = table(spark, sf, "customer").groupBy(part.alias("part")).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("body"))
    whole.select("part", F.when(F.col("part") % 7 == 3, F.substring("body", 1, 50)).otherwise(F.col("body"))).write.partitionBy("part").text(root)
    return landing.json_table(spark, root, "key string, checked_at bigint, kind string")


CACHED_RECORDS = "SELECT 'c' || c_custkey AS key, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 86400 END AS checked_at, c_mktsegment AS kind FROM customer WHERE (c_custkey // 100) % 7 <> 3"


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents as log files, fifty to a file, read line by line."""
    root = f"{_folder(spark)}/logs-{uuid.uuid4().hex}"
    logs = table(spark, sf, "documents").filter("text is not null").groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"]), "\n").alias("value"))
    logs.write.partitionBy("part").text(root)
    return landing.log_lines(spark, root).select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part"), F.col("ord").alias("line"), F.md5(F.encode("line", "UTF-8")).alias("digest"))


LOG_FILES = """WITH l AS (SELECT doc_id // 50 AS part, string_split(string_agg(text, chr(10) ORDER BY doc_id) || chr(10), chr(10)) AS s FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 50)
SELECT part, unnest(range(len(s)))::INT AS line, md5(unnest(s)) AS digest FROM l"""


def fixture_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images and their expected texts, paired by name; some lack one of the two, some leave fields out."""
    root, k = f"{_folder(spark)}/fixtures-{uuid.uuid4().hex}", F.col("doc_id")
    d = table(spark, sf, "documents").filter("text is not null")
    file = lambda kind: F.concat(F.lit("d"), k.cast("string"), F.lit(f".{kind}")).alias("name")
    said = F.to_json(F.struct(F.col("text").alias("expected_text"), F.when(k % 4 > 0, F.col("lang")).alias("language"), F.when(k % 3 > 0, k % 5 / 3 - 0.2).alias("min_similarity")))
    write_images(d.filter("doc_id % 10 <> 3").select(file("png"), F.col("text").cast("binary").alias("content")).unionByName(d.filter("doc_id % 10 <> 7").select(file("json"), said.cast("binary").alias("content"))), root, sharded=True)
    pairs = landing.fixtures(spark, root)
    return pairs.select("name", "language", F.sha2("expected_text", 256).alias("sha256"), F.round("min_similarity", 6).alias("min_similarity"), F.regexp_extract("image", "([^/]+)$", 1).alias("image"))


FIXTURE_PAIRS = """SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 4 > 0 THEN coalesce(lang, 'eng') ELSE 'eng' END AS language, sha256(text) AS sha256, round(CASE WHEN doc_id % 3 > 0 THEN greatest(0.0::DOUBLE, least(1.0, (doc_id % 5) / 3.0::DOUBLE - 0.2)) ELSE 0 END, 6) AS min_similarity, 'd' || doc_id || '.png' AS image
FROM documents WHERE text <> '' AND doc_id % 10 NOT IN (3, 7)"""


def colour_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of parts as codes of subtitle styles, and what is read back from them and from spellings of them."""
    r, g, b = (F.col("p_partkey") * m % 256 for m in (7, 31, 101))
    code = T.ass_colour(r, g, b)
    spelt = F.element_at(F.array(code, F.lower(code), F.replace(code, F.lit("&"), F.lit("")), F.substring(code, 3, 6), F.concat(code, F.lit("0"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    back = T.rgb_of_ass(spelt)
    return table(spark, sf, "part").select("p_partkey", code.alias("code"), back["r"].alias("r"), back["g"].alias("g"), back["b"].alias("b"))


COLOUR_CODES = """WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 31 % 256 AS g, p_partkey * 101 % 256 AS b FROM part)
SELECT p_partkey, printf('&H%02X%02X%02X&', b, g, r) AS code, CASE WHEN p_partkey % 5 < 4 THEN r END::INT AS r, CASE WHEN p_partkey % 5 < 4 THEN g END::INT AS g, CASE WHEN p_partkey % 5 < 4 THEN b END::INT AS b FROM c"""


QUERIES = {
    "cached_records": (cached_records, CACHED_RECORDS),
    "log_files": (log_files, LOG_FILES),
    "fixture_pairs": (fixture_pairs, FIXTURE_PAIRS),
    "colour_codes": (colour_codes, COLOUR_CODES),
}
