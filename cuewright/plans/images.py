"""Queries over images and packets in binary columns, built of the tables' bytes and numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions.text import plain_text_packet
from ..sources.images import pgm_files, spread, write_images
from .flows import _folder
from .stand_ins import table

_CLEAR = bytes(x for i in range(256) for x in (i * 37 % 256, i * 91 % 256, i * 53 % 256, i * 29 % 256))
_DARK = bytes(x for i in range(256) for x in (i * 7 % 90, i * 7 % 90, i * 7 % 90, i * 29 % 256))


def subtitle_rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as bitmaps of palette numbers: with a bright palette, a dark one or none, grey or in two levels."""
    d = table(spark, sf, "documents").withColumn("raw", F.col("text").cast("binary"))
    width, stride = 16 + F.col("doc_id") % 17, 16 + F.col("doc_id") % 17 + F.col("doc_id") % 3
    palette = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("binary")).when(F.col("doc_id") % 5 == 1, F.lit(_DARK)).otherwise(F.lit(_CLEAR))
    made = d.select("doc_id", images.raster(width, F.floor(F.octet_length("raw") / stride), stride, F.col("raw"), palette, F.col("doc_id") % 2 == 0).alias("r"))
    return made.select("doc_id", F.sha2("r.pgm", 256).alias("pgm_sha256"), "r.visible")


SUBTITLE_RASTERS = """WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h, 16 + doc_id % 17 AS w, 16 + doc_id % 17 + doc_id % 3 AS stride FROM documents),
k AS (SELECT doc_id, w, stride, len(h) // stride AS n, unnest(h) AS v, generate_subscripts(h, 1) - 1 AS k FROM d),
p AS (SELECT doc_id, w, n, k // stride AS y, k % stride AS x, ('0x' || v)::INT AS i, (('0x' || v)::INT * 29) % 256 AS a FROM k WHERE k // stride < n AND k % stride < w),
c AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN i > 0 ELSE a > 16 END AS shows, CASE WHEN doc_id % 5 = 1 THEN (i * 7) % 90 ELSE (77 * ((i * 37) % 256) + 150 * ((i * 91) % 256) + 29 * ((i * 53) % 256)) >> 8 END AS l FROM p),
g AS (SELECT *, CASE WHEN NOT shows THEN 255 WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 255 - (l * a + 127) // 255 WHEN l >= 160 THEN 0 WHEN l >= 95 THEN 64 ELSE 255 END AS grey FROM c),
f AS (SELECT doc_id, bool_or(shows) AS visible, bool_or(shows AND CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 2 = 0 THEN grey < 220 ELSE l >= 95 END) AS strong FROM g GROUP BY doc_id),
r AS (SELECT doc_id, y, any_value(w) AS w, any_value(n) AS n, any_value(visible) AS visible, string_agg(CASE WHEN doc_id % 2 = 0 THEN repeat(printf('%02x', o), 2) ELSE printf('%02x', o) END, '' ORDER BY x) AS line
  FROM (SELECT g.*, visible, CASE WHEN visible AND NOT strong THEN CASE WHEN shows THEN 0 ELSE 255 END ELSE grey END AS o FROM g JOIN f USING (doc_id)) GROUP BY doc_id, y),
i AS (SELECT doc_id, any_value(visible) AS visible, sha256(unhex(hex(encode('P5' || chr(10) || any_value(w) * (2 - doc_id % 2) || ' ' || any_value(n) * (2 - doc_id % 2) || chr(10) || '255' || chr(10))) || string_agg(repeat(line, (2 - doc_id % 2)::BIGINT), '' ORDER BY y))) AS pgm_sha256 FROM r GROUP BY doc_id)
SELECT doc_id, pgm_sha256, visible FROM documents LEFT JOIN i USING (doc_id)"""


def _drawn(width: Column, height: Column, pixel) -> Column:
    """Pixels (x, y) in rows, as bytes."""
    row = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.lpad(F.hex(pixel(x, y)), 2, "0")), "")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), height - 1), row), ""))


def image_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words cut out of parts' image files: bands of four or five rows, columns of ink at uneven distances."""
    key = F.col("p_partkey").cast("int")
    width, height = (20 + F.col("p_size")).cast("int"), (12 + key % 20).cast("int")
    inked = lambda x: ((x * 3 + key) % 11 < 7) & (F.floor(x / 6) % 3 > 0)
    line = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.when(inked(x), F.lpad(F.hex(key % 245), 2, "0")).otherwise("FF")), "")
    band = F.concat(F.repeat(line, 5 - key % 2), F.repeat(F.repeat(F.lit("FF"), width), 2 + key % 2))  # rows alike, seven by seven
    pixels = F.unhex(F.substring(F.repeat(band, F.ceil(height / 7).cast("int")), F.lit(1), 2 * width * height))
    head = F.concat(F.lit("P5\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n")).cast("binary")
    folder = f"{_folder(spark)}/images-{uuid.uuid4().hex}"
    write_images(spread(table(spark, sf, "part"), "p_partkey").select(F.concat(key.cast("string"), F.lit(".pgm")).alias("name"), F.concat(head, pixels).alias("content")), folder, sharded=True)
    found = pgm_files(spark, folder).select(F.split("name", r"\.")[0].cast("long").alias("p_partkey"), images.word_crops(F.col("content")).alias("words"))
    words = found.select("p_partkey", F.posexplode("words").alias("word", "c"))
    return words.select("p_partkey", "word", "c.left", "c.top", "c.right", "c.bottom", F.sha2("c.pgm", 256).alias("sha256"))


IMAGE_WORDS = """WITH i AS (SELECT p_partkey, p_partkey % 245 AS ink, 20 + p_size AS w, 12 + p_partkey % 20 AS h FROM part),
y AS (SELECT * FROM (SELECT *, unnest(range(h)) AS y FROM i) WHERE y % 7 < 5 - p_partkey % 2),
x AS (SELECT * FROM (SELECT *, unnest(range(w)) AS x FROM i) WHERE (x * 3 + p_partkey) % 11 < 7 AND (x // 6) % 3 > 0),
b AS (SELECT p_partkey, min(y) AS t, max(y) + 1 AS e FROM (SELECT *, y - row_number() OVER (PARTITION BY p_partkey ORDER BY y) AS g FROM y) GROUP BY p_partkey, g HAVING count(*) >= 4),
n AS (SELECT x.*, t, e, x - lag(x) OVER (PARTITION BY p_partkey, t ORDER BY x) - 1 >= greatest(2, least(8, (e - t) // 6)) AS new FROM x JOIN b USING (p_partkey)),
s AS (SELECT p_partkey, any_value(ink) AS ink, any_value(w) AS w, any_value(h) AS h, t, e, g, min(x) AS l, max(x) + 1 AS r FROM (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY p_partkey, t ORDER BY x) AS g FROM n) GROUP BY p_partkey, t, e, g HAVING max(x) > min(x)),
c AS (SELECT p_partkey, ink, greatest(l - 2, 0) AS l, greatest(t - 2, 0) AS t, least(r + 2, w) AS r, least(e + 2, h) AS e FROM s QUALIFY count(*) OVER (PARTITION BY p_partkey, t) >= 2)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY t, l) - 1)::INT AS word, l::INT AS "left", t::INT AS top, r::INT AS "right", e::INT AS bottom,
  sha256(unhex(hex(encode('P5' || chr(10) || (r - l) || ' ' || (e - t) || chr(10) || '255' || chr(10))) || array_to_string([array_to_string([CASE WHEN y % 7 < 5 - p_partkey % 2 AND (x * 3 + p_partkey) % 11 < 7 AND (x // 6) % 3 > 0 THEN printf('%02x', ink) ELSE 'ff' END for x in range(l, r)], '') for y in range(t, e)], ''))) AS sha256 FROM c"""


def pgm_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes cut out of suppliers' image files; some headers are spaced oddly, some files are no such image or too short."""
    key = F.col("s_suppkey").cast("int")
    width, height = 5 + key % 30, 4 + key % 9
    pixels = _drawn(width, height, lambda x, y: (x * 31 + y * 17 + key) % 256)
    size = F.concat(width.cast("string"), F.lit(" "), height.cast("string"))
    head = F.element_at(F.array(F.concat(F.lit("P5\n"), size, F.lit("\n255\n")), F.concat(F.lit("P5"), size, F.lit("\t255 ")), F.concat(F.lit("P6\n"), size, F.lit("\n255\n")), F.concat(F.lit("P5 "), size, F.lit(" 254\n")), F.concat(F.lit("P5 \r\n"), size, F.lit("\n\n0255\n"))), key % 5 + 1)
    content = F.concat(head.cast("binary"), F.when(key % 7 == 0, F.lit(b"\x01")).otherwise(pixels))
    folder = f"{_folder(spark)}/images-{uuid.uuid4().hex}"
    write_images(table(spark, sf, "supplier").select(F.concat(key.cast("string"), F.lit(".pgm")).alias("name"), content.alias("content")), folder)
    own = F.split("name", r"\.")[0].cast("long")
    box = F.struct((own % 13 - 3).alias("left"), (own % 11 - 2).alias("top"), (own % 13 + own % 6).alias("right"), (own % 11 + 2).alias("bottom"))
    made = pgm_files(spark, folder).select(own.alias("s_suppkey"), "head.width", "head.height", images.cropped(F.col("content"), box).alias("crop"))
    return made.select("s_suppkey", "width", "height", F.sha2("crop", 256).alias("crop_sha256"))


PGM_CROPS = """WITH i AS (SELECT s_suppkey AS k, 5 + s_suppkey % 30 AS w, 4 + s_suppkey % 9 AS h, s_suppkey % 5 NOT IN (2, 3) AS ok FROM supplier),
b AS (SELECT *, greatest(k % 13 - 3, 0) AS l, greatest(k % 11 - 2, 0) AS t, k % 13 + k % 6 AS r, k % 11 + 2 AS e FROM i),
c AS (SELECT *, greatest(l - 3, 0) AS x0, greatest(t - 2, 0) AS y0, least(r + 3, w) AS x1, least(e + 2, h) AS y1 FROM b WHERE ok AND k % 7 <> 0 AND r > l AND e > t AND l < w AND t < h),
d AS (SELECT k, sha256(unhex(hex(encode('P5' || chr(10) || (x1 - x0) || ' ' || (y1 - y0) || chr(10) || '255' || chr(10))) || array_to_string([array_to_string([printf('%02x', (x * 31 + y * 17 + k) % 256) for x in range(x0, x1)], '') for y in range(y0, y1)], ''))) AS crop_sha256 FROM c)
SELECT i.k AS s_suppkey, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height, crop_sha256 FROM i LEFT JOIN d ON i.k = d.k"""


def text_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of whole texts as text packets with styles: some with boxes, some cut short, some of a wrong length."""
    lines = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    styled = F.expr(r"case line % 4 when 0 then said when 1 then concat('<font size=3>', said, '</FONT>') when 2 then concat('{\\fs20}', said, '{\\an8\\fnArial}') else concat('<i>', said, '</i>') end")
    raw = styled.cast("binary")
    size = F.least(F.octet_length(raw), F.lit(65535)) + F.when(F.expr("(doc_id + line) % 9 = 4"), 3).otherwise(0)
    packet = F.concat(F.unhex(F.lpad(F.hex(F.least(size, F.lit(65535))), 4, "0")), raw, F.when(F.expr("(doc_id + line) % 3 = 0"), F.unhex(F.lit("0000000C7374796C00010000"))).otherwise(F.lit(b"")))
    packet = F.when(F.expr("(doc_id + line) % 11 = 5"), F.substring(packet, 1, 1)).otherwise(packet)
    made = lines.select("doc_id", "line", packet.alias("was"), plain_text_packet(packet).alias("now"))
    return made.select("doc_id", "line", (F.col("was") != F.col("now")).alias("changed"), F.sha2("now", 256).alias("sha256"))


TEXT_PACKETS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line, hex(encode(CASE line % 4 WHEN 0 THEN said WHEN 1 THEN '<font size=3>' || said || '</FONT>' WHEN 2 THEN '{\fs20}' || said || '{\an8\fnArial}' ELSE '<i>' || said || '</i>' END)) AS raw FROM l),
n AS (SELECT *, length(raw) // 2 AS size, least(least(length(raw) // 2, 65535) + CASE WHEN (doc_id + line) % 9 = 4 THEN 3 ELSE 0 END, 65535) AS named FROM s),
p AS (SELECT doc_id, line, size, named, raw || CASE WHEN (doc_id + line) % 3 = 0 THEN '0000000C7374796C00010000' ELSE '' END AS body, (doc_id + line) % 11 = 5 AS short FROM n),
t AS (SELECT *, NOT short AND named <= length(body) // 2 AS whole, decode(unhex(CASE WHEN named <= length(body) // 2 THEN body[1:2 * named] ELSE '' END)) AS said FROM p),
c AS (SELECT *, encode(replace(regexp_replace(regexp_replace(regexp_replace(said, '<\s*/?font([ \t][^>]*)?>', '', 'gi'), '\\fsc[xy][0-9.+-]*|\\fs[0-9.+-]+', '', 'gi'), '\\fn[^\\{}]*', '', 'gi'), '{}', '')) AS clean FROM t),
k AS (SELECT doc_id, line, CASE WHEN short THEN printf('%04X', named)[1:2] ELSE printf('%04X', named) || body END AS was,
  CASE WHEN whole THEN printf('%04X', octet_length(clean)) || hex(clean) END AS now FROM c)
SELECT doc_id, line, was <> coalesce(now, was) AS changed, sha256(unhex(coalesce(now, was))) AS sha256 FROM k"""


QUERIES = {
    "subtitle_rasters": (subtitle_rasters, SUBTITLE_RASTERS),
    "image_words": (image_words, IMAGE_WORDS),
    "pgm_crops": (pgm_crops, PGM_CROPS),
    "text_packets": (text_packets, TEXT_PACKETS),
}
