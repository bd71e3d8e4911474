"""Queries through landed payloads: the driver's tables written as service answers, read back, and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import releases as R
from ..operators import assess, audit
from ..sources import landing
from .stand_ins import table


def answers(rows: DataFrame, *fields: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as a JSON answer (body); null fields are missing, and ``"#2"`` stands for the number 2."""
    return rows.select(*keep, F.replace(F.to_json(F.struct(*fields)), F.lit('"#2"'), F.lit("2")).alias("body"))


def case(by: str, n: int, at: int, value: Column) -> Column:
    return F.when(F.expr(f"({by}) % {n} = {at}"), value)


def _queue_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as queue records that name their item in one of four ways."""
    user = F.col("user_id")
    at = lambda k, v: case("event_id", 4, k, v)
    made = answers(
        table(spark, sf, "events"), F.col("event_id").alias("id"), at(0, user).alias("episodeId"), at(1, F.struct(user.alias("id"), (F.col("event_id") * 3).alias("episodeFileId"))).alias("episode"),
        at(2, F.array(F.struct(user.alias("id")), F.struct((user + 1).alias("id")))).alias("episodes"), at(3, F.array(user)).alias("episodeIds"), F.col("event_type").alias("status"),
        F.expr("case when event_id % 2 = 0 then 'torrent' else '#2' end").alias("protocol"), F.expr("case when event_id % 3 <> 0 then event_id % 1000 end").alias("size"),
        case("event_id", 5, 0, F.lit("Bad FILE")).alias("errorMessage"), case("event_id", 3, 1, F.array(F.struct(F.lit("Title").alias("title"), F.array(F.lit("Wrong Season")).alias("messages")))).alias("statusMessages"),
    )
    return landing.records(made, "body")


def landed_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = landing.queue_items(_queue_answers(spark, sf), "tv")
    return q.select("id", "item_id", "status", "protocol", "size", "left", "own_file_id", R.is_torrent(F.col("protocol")).alias("torrent"), R.status_text(F.col("error"), F.col("messages")).alias("said"))


LANDED_QUEUE = """SELECT event_id AS id, user_id AS item_id, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 'torrent' ELSE '2' END AS protocol, CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 ELSE 0 END::BIGINT AS size, 0::BIGINT AS left,
  CASE WHEN event_id % 4 = 1 THEN event_id * 3 END AS own_file_id, true AS torrent, concat_ws(chr(10), CASE WHEN event_id % 5 = 0 THEN 'bad file' END, CASE WHEN event_id % 3 = 1 THEN 'title' || chr(10) || 'wrong season' END) AS said FROM events"""


def landed_active(spark: SparkSession, sf: str) -> DataFrame:
    return landing.active_ids(_queue_answers(spark, sf))


LANDED_ACTIVE = "SELECT user_id AS item_id FROM events UNION SELECT user_id + 1 FROM events WHERE event_id % 4 = 2"


def _history_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as history records; some without a date or with a bad one."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    made = answers(
        table(spark, sf, "orders"), F.col("o_orderkey").alias("id"), case("o_orderkey", 2, 0, F.col("o_custkey")).alias("episodeId"), case("o_orderkey", 2, 1, F.struct(F.col("o_custkey").alias("id"))).alias("episode"),
        F.expr("case o_orderstatus when 'F' then 'downloadFolderImported' else 'grabbed' end").alias("eventType"), F.expr("case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 'soon' end").alias("_"),
        F.when(F.expr("o_orderkey % 7 <> 0"), F.when(F.expr("o_orderkey % 11 = 0"), F.lit("soon")).otherwise(F.concat(day, F.lit("T12:00:00Z")))).alias("date"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("downloadId"),
    )
    return landing.records(made, "body")


def landed_history(spark: SparkSession, sf: str) -> DataFrame:
    return landing.history(_history_answers(spark, sf), "tv", min_day=9000).select("id", "item_id", "event_type", "day", "download_id")


_HISTORY_SQL = """h AS (SELECT o_orderkey AS id, o_custkey AS item_id, o_orderstatus, 'd' || o_custkey AS download_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T12:00:00Z' END AS date FROM orders),
d AS (SELECT *, CASE WHEN date <> 'soon' THEN date_diff('day', DATE '1970-01-01', CAST(date[1:10] AS DATE)) END::INT AS day FROM h)"""
LANDED_HISTORY = f"""WITH {_HISTORY_SQL} SELECT id, item_id, 'downloadFolderImported' AS event_type, day, download_id FROM d WHERE o_orderstatus = 'F' AND (day IS NULL OR day >= 9000)"""


def history_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The history row to act on: one given by hand, else the newest of a download."""
    raw = _history_answers(spark, sf)
    history = raw.select(landing.variant("v", "$.id", "bigint").alias("id"), landing.variant("v", "$.date", "string").alias("date"), landing.variant("v", "$.downloadId", "string").alias("download_id"))
    items = table(spark, sf, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("download_id"))
    given = F.when(F.col("download_id").endswith("5"), F.lit(999).cast("long"))
    return landing.current_history_id(given, history, items, depth=10)


HISTORY_IDS = f"""WITH {_HISTORY_SQL}, n AS (SELECT download_id, id, row_number() OVER (PARTITION BY download_id ORDER BY date DESC NULLS LAST, id DESC) AS place FROM h)
SELECT c.download_id, CASE WHEN c.download_id LIKE '%5' THEN 999 ELSE n.id END AS history_id FROM (SELECT 'd' || c_custkey AS download_id FROM customer) c LEFT JOIN n ON c.download_id = n.download_id AND place = 1"""


def landed_series(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as series of their orders; files are embedded, looked up by id, or unknown."""
    key = F.col("o_orderkey")
    media = lambda path: F.struct(F.concat(F.lit(path), key.cast("string")).alias("path"), F.struct(F.lit("English / Japanese").alias("audioLanguages"), case("o_orderkey", 2, 0, F.lit("eng")).alias("subtitles")).alias("mediaInfo"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    episode = F.struct(
        key.alias("id"), F.when(F.expr("o_orderkey % 13 <> 0"), key + 7).alias("episodeFileId"), F.expr("case o_orderkey % 5 when 0 then false when 1 then null else true end").alias("hasFile"),
        case("o_orderkey", 2, 0, day).alias("airDate"), case("o_orderkey", 2, 1, F.concat(day, F.lit("T01:00:00Z"))).alias("airDateUtc"), case("o_orderkey", 3, 1, media("e")).alias("episodeFile"),
    )
    orders = table(spark, sf, "orders")
    series = landing.records(answers(orders.groupBy("o_custkey").agg(F.collect_list(episode).alias("episodes")), F.col("episodes")), "body")
    files = landing.records(answers(orders.filter("o_orderkey % 3 = 0"), (key + 7).alias("id"), media("f")["path"].alias("path"), media("f")["mediaInfo"].alias("mediaInfo")), "body")
    return landing.tv_inventory(series, files).select("kind", "item_id", "file_id", "day", "path", "info_audio", "info_subtitles")


LANDED_SERIES = """SELECT 'tv' AS kind, o_orderkey AS item_id, o_orderkey + 7 AS file_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::INT AS day, CASE o_orderkey % 3 WHEN 1 THEN 'e' || o_orderkey WHEN 0 THEN 'f' || o_orderkey END AS path,
  CASE WHEN o_orderkey % 3 < 2 THEN 'English / Japanese' END AS info_audio, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 THEN 'eng' END AS info_subtitles FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0"""


def landed_movies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as movies with one, two or no release dates (one of them null); only the even ones are asked for."""
    dates = F.expr("""case p_partkey % 4 when 0 then '"digitalRelease":"2020-01-02T00:00:00Z",' when 1 then '"digitalRelease":null,"inCinemas":"2019-05-05",' when 2 then '"inCinemas":"2019-05-05",' else '' end""")
    file = F.expr("""concat('"movieFile":{"id":', p_partkey * 2, ',"path":"m', p_partkey, '","languages":[{"name":"English"},{"name":"Japanese"}]}')""")
    body = F.concat(F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"year":'), (2000 + F.col("p_size")).cast("string"), F.lit(","), dates, F.expr("case when p_partkey % 9 = 0 then '\"hasFile\":false,' else '' end"), F.expr("case when p_partkey % 3 = 0 then concat('\"movieFileId\":', p_partkey, ',') else '' end"), file, F.lit("}"))
    movies = landing.movie_inventory(landing.records(table(spark, sf, "part").select(body.alias("body")), "body"))
    wanted = table(spark, sf, "part").filter("p_partkey % 2 = 0 or p_partkey % 4 = 1").select(F.col("p_partkey").alias("item_id"))
    return landing.only(movies, wanted).select("kind", "item_id", "file_id", "day", "path", F.array_join("languages", ",").alias("languages"))


LANDED_MOVIES = """SELECT 'movie' AS kind, p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey * 2 END AS file_id, date_diff('day', DATE '1970-01-01', CASE p_partkey % 4 WHEN 0 THEN DATE '2020-01-02' WHEN 2 THEN DATE '2019-05-05' WHEN 3 THEN make_date(2000 + p_size, 1, 1) END)::INT AS day,
  'm' || p_partkey AS path, 'English,Japanese' AS languages FROM part WHERE p_partkey % 9 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 4 = 1)"""


def _release_answers(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> DataFrame:
    """Line items as the release lists of parts, of those asked for (item_id) if given: single episodes, packs, ranges and hinted titles in eight shapes."""
    shape, part = "l_orderkey + l_linenumber", F.col("l_partkey")
    at = lambda k, v: case(shape, 8, k, v)
    none = F.lit(None).cast("array<struct<id:bigint>>")
    mapped = F.when(F.expr(f"({shape}) % 8 in (0, 5)"), F.array(F.struct(part.cast("long").alias("id")))).when(F.expr(f"({shape}) % 8 = 1"), F.array(F.struct(part.cast("long").alias("id")), F.struct((part + 1).cast("long").alias("id")))).otherwise(none)
    title = F.concat(F.expr(f"case when ({shape}) % 8 = 6 then 'Show.Part.1-12' else 'Show.S01E05' end"), F.expr("case when l_linenumber % 2 = 0 then '.Dual-Audio' else '' end"))
    release = F.struct(
        title.alias("title"), F.expr(f"case when l_returnflag <> 'R' then 'usenet' when ({shape}) % 8 = 7 then '#2' else 'Torrent' end").alias("protocol"),
        F.when(F.col("l_linestatus") == "O", F.array(F.struct(F.lit("English").alias("name")), F.struct(F.lit("ja").alias("name")))).alias("languages"), F.when(F.col("l_linestatus") != "O", F.struct(F.lit("Japanese").alias("name"))).alias("language"),
        F.col("l_quantity").cast("long").alias("customFormatScore"), F.col("l_linenumber").cast("long").alias("qualityWeight"), (F.col("l_returnflag") == "A").alias("rejected"),
        F.expr("case when l_linenumber % 3 = 0 then array('Existing file meets cutoff') else array('Wrong quality', 'Existing file meets cutoff') end").alias("rejections"), F.expr("case when l_linenumber = 7 then false end").alias("downloadAllowed"),
        at(5, F.lit("seasonPack")).alias("releaseType"), mapped.alias("mappedEpisodeInfo"), at(2, F.array(part)).alias("episodeIds"), at(3, part + 1).alias("episodeId"), at(4, F.array(F.lit(1), F.lit(2))).alias("episodeNumbers"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.to_json(release).alias("r")))), lambda s: s["r"])
    rows = table(spark, sf, "lineitem")
    rows = rows if asked is None else rows.join(asked, rows["l_partkey"] == asked["item_id"], "left_semi")
    lists = rows.groupBy("l_partkey").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("body"))
    return landing.records(lists.select("l_partkey", F.replace("body", F.lit('"#2"'), F.lit("2")).alias("body")), "body", "l_partkey")


def landed_releases(spark: SparkSession, sf: str) -> DataFrame:
    """The best release of each item for its one episode, English and Japanese by metadata or title."""
    releases = landing.releases(_release_answers(spark, sf), F.col("l_partkey"))
    best = audit.best_release(releases, ["eng", "jpn"], [], "custom-format-or-title", prefer_non_torrent=True, episodes=True)
    return best.select("item_id", F.col("release.ord").alias("ord"), F.col("release.title").alias("title"), R.score(F.col("release")).alias("score"), F.array_join("release.languages", ",").alias("languages"))


LANDED_RELEASES = """WITH n AS (SELECT *, (l_orderkey + l_linenumber) % 8 AS k, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord FROM lineitem),
f AS (SELECT l_partkey AS item_id, ord, CASE WHEN k = 6 THEN 'Show.Part.1-12' ELSE 'Show.S01E05' END || CASE WHEN l_linenumber % 2 = 0 THEN '.Dual-Audio' ELSE '' END AS title, CAST(trunc(l_quantity) AS BIGINT) + l_linenumber AS score, CASE WHEN l_linestatus = 'O' THEN 'eng,jpn' ELSE 'jpn' END AS languages, l_returnflag <> 'R' AS direct
  FROM n WHERE k IN (0, 2, 7) AND (l_linestatus = 'O' OR l_linenumber % 2 = 0) AND l_linenumber <> 7 AND (l_returnflag <> 'A' OR l_linenumber % 3 = 0))
SELECT item_id, ord, title, score, languages FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY direct DESC, score DESC, ord DESC) AS place FROM f) WHERE place = 1"""


def title_hints(spark: SparkSession, sf: str) -> DataFrame:
    """What titles, formats and packs say, over every release of every part."""
    r = landing.releases(_release_answers(spark, sf), F.col("l_partkey")).select(F.struct("*").alias("r"))
    release = F.col("r")
    by = [F.count_if(R.satisfies(release, ["eng"], [], p)).alias(p.replace("-", "_")) for p in R.POLICIES]
    return r.groupBy(R.numeric_range(release["title"]).alias("range"), R.is_pack(release["release_type"]).alias("pack"), R.title_hints_audio(release["title"], ["eng"], False).alias("audio_hint"), R.evidence(release, ["eng"], "title-guess").alias("evidence")).agg(F.count("*").alias("n"), *by)


TITLE_HINTS = """WITH n AS (SELECT (l_orderkey + l_linenumber) % 8 = 6 AS range, (l_orderkey + l_linenumber) % 8 = 5 AS pack, l_linenumber % 2 = 0 AS audio_hint, l_linestatus = 'O' AS eng FROM lineitem)
SELECT range, pack, audio_hint, 'release languages [' || CASE WHEN eng THEN 'eng, jpn' ELSE 'jpn' END || ']' || CASE WHEN audio_hint THEN '; title audio hint' ELSE '' END AS evidence, count(*) AS n, count(*) FILTER (eng) AS strict, 0::BIGINT AS custom_format, count(*) FILTER (audio_hint) AS custom_format_or_title, count(*) FILTER (audio_hint) AS title_guess FROM n GROUP BY ALL"""


def import_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first manual-import item of each download that is for its one episode."""
    at, order = lambda k, v: case("l_linenumber", 4, k, v), F.col("l_orderkey").cast("long")
    made = answers(
        table(spark, sf, "lineitem"), F.concat(F.lit("d"), order.cast("string")).alias("downloadId"), F.concat(F.lit("/in/"), F.col("l_partkey").cast("string")).alias("path"), F.expr("l_linenumber * 10000000L + l_partkey").alias("ord"),
        F.when(F.expr("l_linenumber % 4 = 0"), F.array(F.struct(order.alias("id")))).when(F.expr("l_linenumber % 4 = 1"), F.array(F.struct(order.alias("id")), F.struct((order + 1).alias("id")))).alias("episodes"),
        at(2, F.array(order)).alias("episodeIds"), at(3, order + F.col("l_partkey") % 2).alias("episodeId"), F.array(F.struct(F.lit("Unknown Movie").alias("reason"))).alias("rejections"),
    )
    items = landing.import_items(landing.records(made, "body"))
    pending = table(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("download_id"), (F.col("o_orderstatus") == "F").alias("satisfied"))
    fits = R.matches_item(F.col("episodes"), F.col("episode_ids"), F.col("episode_id"), F.substring("download_id", 2, 20).cast("long"))
    first = audit.first_import(pending, items, fits)
    return first.select("download_id", "item.ord", "item.path", R.unknown_movie(F.col("item.rejections")).alias("unknown"))


IMPORT_ITEMS = """SELECT 'd' || l_orderkey AS download_id, min(l_linenumber::BIGINT * 10000000 + l_partkey) AS ord, '/in/' || arg_min(l_partkey, l_linenumber::BIGINT * 10000000 + l_partkey) AS path, true AS unknown FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'F' AND (l_linenumber % 4 IN (0, 2) OR l_linenumber % 4 = 3 AND l_partkey % 2 = 0) GROUP BY l_orderkey"""


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as probe dumps of their line items as streams."""
    index = F.expr("cast(l_linenumber * 1000000 + l_partkey as int)")
    stream = F.struct(
        index.alias("index"), F.expr("case l_linenumber when 1 then 'video' when 5 then 'attachment' else case l_returnflag when 'R' then 'subtitle' else 'audio' end end").alias("kind"),
        F.expr("case when l_linenumber = 1 then 'h264' when l_returnflag = 'R' then case l_partkey % 3 when 0 then 'hdmv_pgs_subtitle' when 1 then 'dvd_subtitle' else 'subrip' end else 'aac' end").alias("codec"),
        F.struct(F.expr("case when l_partkey % 5 = 0 then 0 else 24000 end").alias("num"), F.lit(1001).alias("den")).alias("fps"),
        F.expr("case l_suppkey % 4 when 0 then 'en-US' when 1 then 'und' when 2 then 'ger' end").alias("language"), F.struct(F.expr("l_linenumber = 6").alias("attached_picture")).alias("disposition"),
    )
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(stream).alias("streams"))
    made = answers(lists, F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_id"), F.lit("mkv").alias("container"), F.col("streams"))
    return made.select(F.from_json("body", landing.STREAMS).alias("p")).select("p.*")


def probed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Languages, bitmap subtitles, retagged and auxiliary streams of probe dumps, a row a file."""
    own = landing.flat_streams(_probes(spark, sf)).withColumn("said", F.col("language"))
    skipped, plain, found = landing.bitmap_candidates(own, "skip").limit(1).count(), assess.is_plain(), lambda test: F.nullif(F.count_if(test), F.lit(0))
    files = landing.retagged(own, "eng", F.lit(True)).groupBy("file_id").agg(
        *landing.present_languages(F.col("said")), F.count_if("retagged").alias("retagged"), F.count_if(F.col("language") == "eng").alias("as_eng"),
        found(plain).alias("plain"), F.round(F.max(F.when(plain, F.col("fps"))), 3).alias("fps"), found(landing.is_bitmap()).alias("bitmap"),
    )
    sets = (F.array_join("present_audio", ",").alias("audio"), F.array_join("present_subtitles", ",").alias("subtitles"))
    return files.select("file_id", *sets, "retagged", "as_eng", "plain", "fps", "bitmap", F.lit(skipped).alias("skipped"))


PROBED_FILES = """WITH s AS (SELECT 'o' || l_orderkey AS file_id, CASE l_linenumber WHEN 1 THEN 'video' WHEN 5 THEN 'attachment' ELSE CASE l_returnflag WHEN 'R' THEN 'subtitle' ELSE 'audio' END END AS kind, l_linenumber <> 1 AND l_returnflag = 'R' AND l_partkey % 3 < 2 AS bitmap,
  CASE WHEN l_partkey % 5 <> 0 THEN 24000 / 1001.0 END AS fps, CASE l_suppkey % 4 WHEN 0 THEN 'eng' WHEN 2 THEN 'deu' END AS tag, l_suppkey % 4 IN (1, 3) AS unknown, l_linenumber AS n FROM lineitem)
SELECT file_id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (kind = 'audio'), '') AS audio, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (kind = 'subtitle'), '') AS subtitles, count(*) FILTER (unknown AND kind IN ('audio', 'subtitle')) AS retagged,
  count(*) FILTER (unknown AND kind IN ('audio', 'subtitle')) AS as_eng, nullif(count(*) FILTER (kind <> 'attachment' AND n <> 6), 0) AS plain, round(max(fps) FILTER (kind <> 'attachment' AND n <> 6), 3)::DOUBLE AS fps, nullif(count(*) FILTER (bitmap AND kind = 'subtitle'), 0) AS bitmap, 0 AS skipped FROM s GROUP BY file_id"""


def refreshed_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Library sections (XML) that hold the directories of suppliers."""
    directory = F.concat(F.lit('<Directory key="'), F.col("n_nationkey").cast("string"), F.lit('"><Location path="/media/'), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit('/"/></Directory>'))
    xml = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<MediaContainer>"), F.array_join(F.array_sort(F.collect_list(directory)), ""), F.lit('<Directory key="none"/></MediaContainer>')).alias("xml"))
    sections = landing.library_sections(xml)
    where = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", F.lit("/media"), "n_regionkey", "n_nationkey", F.lit("Show"), "s_suppkey").alias("directory"))
    return landing.sections_of(where, sections).select("s_suppkey", "key", "location")


REFRESHED_SECTIONS = "SELECT s_suppkey, n_nationkey::VARCHAR AS key, '/media/' || n_regionkey || '/' || n_nationkey || '/' AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a tv audit and a movie audit, merged."""
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.lit(1).alias("day"), F.expr("case when p_size % 2 = 0 then 'Japanese' else 'English / Japanese' end").alias("info_audio"), F.lit("").alias("info_subtitles"), F.lit(None).cast("array<string>").alias("languages"))
    none = spark.createDataFrame([], "key string, requirements string, checked_at bigint")
    queued = table(spark, sf, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("item_id"))
    history = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("item_id"), F.lit("2024-01-01").alias("date"), F.lit("downloadFolderImported").alias("event_type"))
    releases = lambda asked: landing.releases(_release_answers(spark, sf, asked), F.col("l_partkey"))
    run = lambda kind: audit.language_audit(files, queued, none, releases, history, audio=["eng", "jpn"], subtitles=[], policy="custom-format-or-title", now=F.lit(0), cooldown_days=30, budget=150, kind=kind)[1]
    return audit.merge_summaries(run("tv"), run("movie"))


AUDIT_SUMMARY = """WITH e AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 10 <> 3 ORDER BY p_partkey DESC LIMIT 150),
r AS (SELECT l_partkey, (l_orderkey + l_linenumber) % 8 IN (0, 2, 7) AS single FROM lineitem WHERE (l_linestatus = 'O' OR l_linenumber % 2 = 0) AND l_linenumber <> 7 AND (l_returnflag <> 'A' OR l_linenumber % 3 = 0)),
c AS (SELECT count(*) AS n, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM r WHERE single)) AS tv, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM r)) AS movie FROM e)
SELECT 2 * (SELECT count(*) FROM part) AS checked, 2 * (SELECT count(*) FROM part WHERE p_size % 2 <> 0) AS satisfied, 2 * (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS missing, 2 * n AS searched, tv + movie AS no_candidate FROM c"""


def replaced_files(spark: SparkSession, sf: str) -> DataFrame:
    """Which file a queue item would replace, and how it is known."""
    q = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("item_id"), F.concat(F.lit("d"), (F.col("o_orderkey") % 50).cast("string")).alias("download_id"), F.expr("case when o_orderkey % 5 = 0 then o_orderkey end").alias("own_file_id"), F.expr("case when o_orderkey % 7 = 0 then -o_orderkey end").alias("nested_file_id"))
    episodes = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") * 1000).alias("file_id"))
    history = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("d"), (F.col("p_partkey") % 40).cast("string")).alias("download_id"), F.col("p_size").cast("string").alias("date"), F.expr("case when p_partkey % 2 = 0 then p_partkey * 7 end").alias("file_id"))
    return audit.queue_file_ids(q, episodes, history, depth=10).select("o_orderkey", "file_id")


REPLACED_FILES = """WITH n AS (SELECT 'd' || (p_partkey % 40) AS download_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 7 END AS f, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_size::VARCHAR DESC, p_partkey DESC) AS place FROM part),
h AS (SELECT download_id, arg_min(f, place) AS f FROM n WHERE place <= 10 AND f IS NOT NULL GROUP BY download_id)
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END, CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey END, CASE WHEN o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey * 1000 END, f) AS file_id FROM orders LEFT JOIN h ON download_id = 'd' || (o_orderkey % 50)"""


def current_files(spark: SparkSession, sf: str) -> DataFrame:
    """History rows with their current file, and the rows that have none."""
    history = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("item_id"))
    files = table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("path"))
    found, errors = audit.current_files(history, files)
    return found.groupBy("path").agg(F.count("*").alias("n")).unionByName(errors.select(F.lit("(none)").alias("path"), F.col("errors").alias("n")))


CURRENT_FILES = """SELECT c_mktsegment AS path, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 GROUP BY 1
UNION ALL SELECT '(none)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)"""


QUERIES = {
    "landed_queue": (landed_queue, LANDED_QUEUE),
    "landed_active_ids": (landed_active, LANDED_ACTIVE),
    "landed_history": (landed_history, LANDED_HISTORY),
    "history_ids": (history_ids, HISTORY_IDS),
    "landed_series": (landed_series, LANDED_SERIES),
    "landed_movies": (landed_movies, LANDED_MOVIES),
    "landed_releases": (landed_releases, LANDED_RELEASES),
    "title_hints": (title_hints, TITLE_HINTS),
    "import_items": (import_items, IMPORT_ITEMS),
    "probed_files": (probed_files, PROBED_FILES),
    "refreshed_sections": (refreshed_sections, REFRESHED_SECTIONS),
    "audit_summary": (audit_summary, AUDIT_SUMMARY),
    "replaced_files": (replaced_files, REPLACED_FILES),
    "current_files": (current_files, CURRENT_FILES),
}
