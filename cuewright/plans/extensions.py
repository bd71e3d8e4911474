"""Queries over pluggable converters and learnt word costs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..operators import converters
from ..sources import landing
from ..sources.images import write_images
from .flows import _folder
from .stand_ins import table


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as profiles of two candidates: their own file, which some lack or hold changed, and a common one."""
    langs = table(spark, sf, "documents").filter("lang is not null").select("lang").distinct()
    root = f"{_folder(spark)}/models-{uuid.uuid4().hex}"
    own = langs.filter("lang < 'f'").select(F.concat("lang", F.lit(".bin")).alias("name"), F.concat(F.lit("model of "), "lang").cast("binary").alias("content"))
    write_images(own.unionByName(langs.limit(1).select(F.lit("common.bin").alias("name"), F.lit(b"common model").alias("content"))), root)
    files = landing.checksums(spark, root).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "sha256")
    both = langs.select("lang", F.posexplode(F.array(F.struct(F.lit("lines").alias("converter"), F.concat("lang", F.lit(".bin")).alias("file")), F.struct(F.lit("whole").alias("converter"), F.lit("common.bin").alias("file")))).alias("ord", "c"))
    sums = F.when(F.col("c.file") == "common.bin", F.sha2(F.lit("common model"), 256)).when(F.col("lang") == "de", F.lit("0")).otherwise(F.concat(F.lit(" "), F.upper(F.sha2(F.concat(F.lit("model of "), "lang"), 256))))
    registry = both.select(F.col("lang").alias("profile"), "ord", "c.converter", "c.file", sums.alias("sha256"), F.when((F.col("lang") == "es") & (F.col("ord") == 1), F.lit("common.bin")).when(F.col("lang") == "fr", F.lit("gone.bin")).alias("override"))
    return converters.resolve(registry, files)


_MODELS_SQL = """m AS (SELECT DISTINCT lang AS profile, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'es' OR lang >= 'f' THEN 'whole' ELSE 'lines' END AS converter,
  CASE WHEN lang = 'fr' THEN 'gone.bin' WHEN lang = 'es' OR lang >= 'f' THEN 'common.bin' ELSE lang || '.bin' END AS file, CASE WHEN lang IN ('es', 'fr') THEN 'override' ELSE 'candidate' END AS chosen,
  CASE WHEN lang = 'fr' THEN 'error' WHEN lang = 'es' THEN 'unchecked' WHEN lang = 'de' THEN 'mismatch' ELSE 'ok' END AS verdict FROM documents WHERE lang IS NOT NULL)"""


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _models(spark, sf)


MODEL_REGISTRY = f"WITH {_MODELS_SQL} SELECT * FROM m"


def converted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts through the converter that the registry chose for their language; those of a profile in error fall back to one that is unknown."""
    chosen = _models(spark, sf).select(F.col("profile").alias("lang"), F.coalesce("converter", F.lit("fallback")).alias("converter"))
    docs = table(spark, sf, "documents").join(F.broadcast(chosen) if chosen.count() <= 10_000 else chosen, "lang")
    images = docs.select(F.col("doc_id").alias("image_id"), "converter", F.col("lang").alias("language"), F.col("text").cast("binary").alias("content"))
    made = converters.converted(images)
    return made.select(F.col("image_id").alias("doc_id"), "converter", "line", F.sha2("text", 256).alias("sha256"), "error")


CONVERTED_LINES = rf"""WITH {_MODELS_SQL}, d AS (SELECT doc_id, text, converter FROM documents JOIN m ON lang = profile WHERE text IS NOT NULL),
b AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank),
l AS (SELECT doc_id, converter, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE converter = 'lines'),
n AS (SELECT doc_id, converter, k, trim(line, blank) AS text FROM l, b WHERE trim(line, blank) <> '')
SELECT doc_id, converter, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS line, sha256(text) AS sha256, NULL AS error FROM n
UNION ALL SELECT doc_id, converter, 0, sha256(trim(text, blank)), NULL FROM d, b WHERE converter = 'whole' AND trim(text, blank) <> ''
UNION ALL SELECT doc_id, 'fallback', NULL, NULL, 'there is no converter fallback' FROM d WHERE converter IS NULL"""


def glued_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every two words of all texts glued together, and their cheapest cut by costs learnt from the same texts."""
    docs = table(spark, sf, "documents")
    lexicon = spark.sparkContext.broadcast(repair.learn(docs))
    tokens = repair.glued(docs, "[A-Za-z]+").filter(F.length("token") >= 8).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.withColumn("cut", repair.cut_words(lexicon, F.col("token")))


GLUED_PAIRS = r"""WITH RECURSIVE w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents),
c AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rank FROM w WHERE regexp_matches(w, '[a-z]') GROUP BY w HAVING count(*) >= 3),
v AS (SELECT w, floor(1000000 * ln(rank * ln(greatest((SELECT count(*) FROM c WHERE rank <= 50000), 3))))::BIGINT AS cost FROM c WHERE rank <= 50000),
d AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest([ws[k] || coalesce(ws[k + 1], '') for k in range(1, len(ws) + 1, 2)]) AS token FROM d) WHERE length(token) >= 8 GROUP BY token),
r(token, low, i, costs, cuts) AS (SELECT DISTINCT lower(token), lower(token), 0, [0]::BIGINT[], [0]::BIGINT[] FROM t
  UNION ALL SELECT token, low, i + 1, list_append(costs, best // 1024), list_append(cuts, best % 1024) FROM (
    SELECT token, low, i, costs, cuts, min((costs[i + 2 - k] + cost) * 1024 + k) AS best
    FROM (SELECT *, unnest(range(1, least(i + 1, (SELECT max(length(w)) FROM v)) + 1)) AS k FROM r WHERE i < length(low)) LEFT JOIN v ON v.w = low[i + 2 - k:i + 1] GROUP BY token, low, i, costs, cuts)),
p(token, cuts, pos, parts) AS (SELECT token, cuts, i, []::VARCHAR[] FROM r WHERE i = length(low) AND costs[i + 1] IS NOT NULL
  UNION ALL SELECT token, cuts, pos - cuts[pos + 1], list_prepend(token[pos - cuts[pos + 1] + 1:pos], parts) FROM p WHERE pos > 0),
s AS (SELECT token, parts FROM p WHERE pos = 0),
g AS (SELECT t.token, n, CASE WHEN len(parts) < 2 OR len(list_filter(parts, lambda x: length(x) <= 2 AND x NOT IN ('a', 'i', 'am', 'an', 'as', 'at', 'be', 'by', 'do', 'go', 'he', 'if', 'in', 'is', 'it', 'me', 'my', 'no', 'of', 'on', 'or', 'so', 'to', 'up', 'us', 'we'))) > 0 THEN NULL
  WHEN parts[2] = 'a' AND length(parts[1]) >= 4 AND parts[1] NOT IN ('what', 'when', 'where', 'book') THEN NULL
  WHEN regexp_matches(t.token, '^[A-Z]') AND length(parts[1]) <= 3 AND len(parts) > 3 AND parts[1] NOT IN ('a', 'i', 'am', 'an', 'as', 'at', 'be', 'by', 'do', 'go', 'he', 'if', 'in', 'is', 'it', 'me', 'my', 'no', 'of', 'on', 'or', 'so', 'to', 'up', 'us', 'we', 'but', 'the', 'why', 'who', 'how', 'let', 'you') THEN NULL
  WHEN len(parts) >= 6 AND length(t.token) / len(parts) < 3.2 THEN NULL ELSE parts END AS parts FROM t LEFT JOIN s ON lower(t.token) = s.token)
SELECT token, n, array_to_string([token[1 + list_sum([length(parts[j])::BIGINT for j in range(1, k)] || [0::BIGINT])::BIGINT:list_sum([length(parts[j])::BIGINT for j in range(1, k + 1)])::BIGINT] for k in range(1, len(parts) + 1)], ' ') AS cut FROM g"""


QUERIES = {
    "glued_pairs": (glued_pairs, GLUED_PAIRS),
    "model_registry": (model_registry, MODEL_REGISTRY),
    "converted_lines": (converted_lines, CONVERTED_LINES),
}
