"""Landed service payloads (JSON, XML, CSV, logs, environment) as DataFrames.

Payloads are read with explicit schemas in permissive mode: a missing or ill-typed field is null, never
an error.  Fields that come in several shapes are read as VARIANT and coalesced.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.media import BITMAP_SUBTITLES
from ..functions.releases import day_number
from ..functions.text import language_tag, redacted, strip
from .images import listed, read_files

MESSAGES = "array<struct<title:string,messages:array<string>>>"
EMPTY_IDS = "array<bigint>"


def variant(column: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(column) if isinstance(column, str) else column, path, kind)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(ord, v): a row a record of JSON files that hold an array or one record, as VARIANT ``v``; bad files drop.

    ``ord`` is the record's place in its file, whatever way Spark splits the input.
    """
    return records(spark.read.text(path, wholetext=True), "value")


def records(answers: DataFrame, body: str, *keep: str) -> DataFrame:
    """The same of answers in a column, beside the columns to keep."""
    parsed = answers.select(*keep, F.try_parse_json(body).alias("_v")).filter("_v is not null")
    return parsed.select(*keep, F.posexplode(F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))).alias("ord", "v"))


NAMED = "struct<name:string,language:string,code:string,iso:string,value:string,label:string>"


def _said(field: Column, kind: str = NAMED) -> Column:
    """What a VARIANT says, an array of strings or objects with names, an object or a string, as an array; null if missing."""
    get = lambda k: F.try_variant_get(field, "$", k)
    names = [part.split(":")[0] for part in kind[7:-1].split(",")]
    one = lambda object_, text: F.coalesce(*(object_[n] for n in names), text)
    many = F.zip_with(get(f"array<{kind}>"), get("array<string>"), one)
    return F.when(field.isNotNull(), F.coalesce(many, F.array(one(get(kind), get("string")))))


def _names(*fields: Column) -> Column:
    """Languages in some VARIANT fields, sorted."""
    texts = F.concat(*(F.coalesce(_said(f), F.array().cast("array<string>")) for f in fields))
    parts = F.flatten(F.transform(F.array_compact(texts), lambda s: F.split(s, r"[,/;|\s]+")))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, language_tag))))
    return F.when(F.coalesce(*fields).isNotNull(), found).otherwise(F.array().cast("array<string>"))


def _first_id(column: str, *paths: str) -> Column:
    return F.coalesce(*(variant(column, p, "bigint") for p in paths))


def queue_items(raw: DataFrame, kind: str) -> DataFrame:
    """Download-queue records (``v``) of tv or movies."""
    item = _first_id("v", "$.episodeId", "$.episode.id", "$.episodes[0].id", "$.episodeIds[0]") if kind == "tv" else _first_id("v", "$.movieId", "$.movie.id")
    return raw.select(
        variant("v", "$.id", "bigint").alias("id"), F.lit(kind).alias("kind"), item.alias("item_id"),
        *(variant("v", f"$.{name}", "string").alias(alias) for name, alias in (("title", "title"), ("status", "status"), ("trackedDownloadState", "state"), ("trackedDownloadStatus", "tracked"), ("added", "added"), ("downloadId", "download_id"), ("errorMessage", "error"))),
        F.coalesce(variant("v", "$.protocol", "string"), variant("v", "$.protocol", "bigint").cast("string")).alias("protocol"),
        F.coalesce(variant("v", "$.size", "bigint"), F.lit(0)).alias("size"), F.coalesce(variant("v", "$.sizeleft", "bigint"), F.lit(0)).alias("left"),
        variant("v", "$.statusMessages", MESSAGES).alias("messages"),
        _first_id("v", "$.movie.movieFileId", "$.movie.movieFile.id", "$.episode.episodeFileId").alias("own_file_id"),
    )


def item_ids(raw: DataFrame) -> DataFrame:
    """(id, item_ids): the distinct ids at the four places a queue record may hold them."""
    ids = lambda p: F.coalesce(variant("v", p, EMPTY_IDS), F.array().cast(EMPTY_IDS))
    nested = F.coalesce(F.transform(variant("v", "$.episodes", "array<variant>"), lambda e: F.try_variant_get(e, "$.id", "bigint")), F.array().cast(EMPTY_IDS))
    single = F.array(variant("v", "$.episodeId", "bigint"), variant("v", "$.episode.id", "bigint"))
    every = F.array_sort(F.array_compact(F.array_union(F.array_union(ids("$.episodeIds"), nested), single)))
    return raw.select(variant("v", "$.id", "bigint").alias("id"), every.alias("item_ids"))


def active_ids(raw: DataFrame) -> DataFrame:
    """The distinct item ids over a whole queue."""
    return item_ids(raw).select(F.explode("item_ids").alias("item_id")).distinct()


def history(raw: DataFrame, kind: str, min_day: int | None = None, wanted: str = "downloadFolderImported", keep: tuple[str, ...] = ()) -> DataFrame:
    """Import history; rows older than ``min_day`` go, rows without a date stay.

    Stored as Parquet by day, the filter prunes row groups; ``paged`` reads pages and stops early.
    """
    item = _first_id("v", "$.episodeId", "$.episode.id") if kind == "tv" else _first_id("v", "$.movieId", "$.movie.id")
    rows = raw.select(
        *keep, variant("v", "$.id", "bigint").alias("id"), F.lit(kind).alias("kind"), item.alias("item_id"),
        variant("v", "$.eventType", "string").alias("event_type"), variant("v", "$.date", "string").alias("date"), variant("v", "$.downloadId", "string").alias("download_id"),
    ).withColumn("day", day_number(F.col("date")))
    rows = rows.filter(F.col("event_type") == wanted)
    return rows if min_day is None else rows.filter(F.col("day").isNull() | (F.col("day") >= min_day))


def tv_inventory(series: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Episodes with a file: kind, item_id, file_id, day and the file's languages; an embedded file object
    comes before one looked up by id."""
    rows = series.select(F.explode(variant("v", "$.episodes", "array<variant>")).alias("e"))
    rows = rows.filter(F.coalesce(variant("e", "$.hasFile", "boolean"), F.lit(True)))
    made = rows.select(
        F.lit("tv").alias("kind"), variant("e", "$.id", "bigint").alias("item_id"), variant("e", "$.episodeFileId", "bigint").alias("file_id"),
        day_number(F.coalesce(variant("e", "$.airDateUtc", "string"), variant("e", "$.airDate", "string"))).alias("day"),
        variant("e", "$.episodeFile", "variant").alias("file"),
    ).filter("item_id is not null and file_id is not null")
    if files is not None:
        looked_up = files.select(variant("v", "$.id", "bigint").alias("file_id"), F.col("v").alias("_file"))
        made = made.join(looked_up, "file_id", "left").withColumn("file", F.coalesce("file", "_file")).drop("_file")
    return _with_file(made)


def movie_inventory(raw: DataFrame) -> DataFrame:
    """Movies with a file. The release day is that of the first date key that is present, even with a null
    value; without any, the first of January of the year."""
    keys = ("digitalRelease", "physicalRelease", "inCinemas")
    present = F.when(F.lit(False), F.lit(None).cast("int"))
    for key in keys:
        there = F.array_contains(F.json_object_keys(F.col("v").cast("string")), key)
        present = present.when(there, day_number(variant("v", f"$.{key}", "string")))
    none = ~F.arrays_overlap(F.json_object_keys(F.col("v").cast("string")), F.array(*map(F.lit, keys)))
    year = F.unix_date(F.try_to_date(F.concat(variant("v", "$.year", "bigint").cast("string"), F.lit("-01-01"))))
    made = raw.filter(F.coalesce(variant("v", "$.hasFile", "boolean"), F.lit(True))).select(
        F.lit("movie").alias("kind"), variant("v", "$.id", "bigint").alias("item_id"), _first_id("v", "$.movieFileId", "$.movieFile.id").alias("file_id"),
        F.when(none, year).otherwise(present).alias("day"), variant("v", "$.movieFile", "variant").alias("file"),
    ).filter("item_id is not null and file_id is not null")
    return _with_file(made)


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.select(
        "kind", "item_id", "file_id", "day", variant("file", "$.path", "string").alias("path"),
        variant("file", "$.mediaInfo.audioLanguages", "string").alias("info_audio"), variant("file", "$.mediaInfo.subtitles", "string").alias("info_subtitles"),
        F.transform(variant("file", "$.languages", "array<variant>"), lambda v: F.try_variant_get(v, "$.name", "string")).alias("languages"),
    )


def only(items: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of the given ids (a semi join; Spark broadcasts the ids if they are few)."""
    return items.join(ids.select(key).distinct(), key, "left_semi")


RELEASE = (
    "struct<title:string,releaseTitle:string,protocol:string,languages:variant,language:variant,subtitleLanguages:variant,subtitles:variant,subtitleLanguage:variant,customFormats:variant,"
    "customFormatScore:bigint,qualityWeight:bigint,rejected:boolean,rejections:array<string>,downloadAllowed:boolean,releaseType:string,mappedEpisodeInfo:array<struct<id:bigint>>,"
    "episodeIds:array<bigint>,episodeId:bigint,episodeNumbers:array<bigint>,absoluteEpisodeNumbers:array<bigint>>"
)


def releases(raw: DataFrame, item: Column) -> DataFrame:
    """Release candidates in list order (``ord``, from ``payloads``) as the structs that ``functions.releases`` works on.

    A record's fields are taken from the VARIANT in one pass, and lists of names made of them, each behind a
    generator, which keeps expressions that name a field from taking it anew.  A filter on the item passes both.
    """
    taken = raw.select(item.alias("item_id"), F.col("ord").cast("long").alias("ord"), F.inline(F.array(variant("v", "$", RELEASE))))
    c = F.col
    formats = F.when(F.schema_of_variant("customFormats").startswith("ARRAY"), F.array_compact(_said(c("customFormats"), "struct<name:string>")))
    named = F.struct(
        _names(c("languages"), c("language")).alias("languages"), _names(c("subtitleLanguages"), c("subtitles"), c("subtitleLanguage")).alias("subtitle_languages"),
        F.coalesce(formats, F.array().cast("array<string>")).alias("custom_formats"),
    )
    plain = {
        "item_id": c("item_id"), "ord": c("ord"), "title": F.coalesce("title", "releaseTitle"), "protocol": c("protocol"), "custom_format_score": c("customFormatScore"), "quality_weight": c("qualityWeight"), "rejected": c("rejected"),
        "rejections": c("rejections"), "download_allowed": c("downloadAllowed"), "release_type": c("releaseType"), "mapped_ids": c("mappedEpisodeInfo.id"), "episode_ids": c("episodeIds"), "episode_id": c("episodeId"),
        "episode_numbers": c("episodeNumbers"), "absolute_numbers": c("absoluteEpisodeNumbers"),
    }
    made = taken.select(*(column.alias(name) for name, column in plain.items()), F.inline(F.array(named)))
    names = list(plain)
    return made.select(*names[:4], "languages", "subtitle_languages", "custom_formats", *names[4:])


def import_items(raw: DataFrame) -> DataFrame:
    """Manual-import items by download id."""
    return raw.select(
        variant("v", "$.downloadId", "string").alias("download_id"), variant("v", "$.path", "string").alias("path"), variant("v", "$.ord", "bigint").alias("ord"),
        F.transform(variant("v", "$.episodes", "array<variant>"), lambda e: F.try_variant_get(e, "$.id", "bigint")).alias("episodes"),
        variant("v", "$.episodeIds", EMPTY_IDS).alias("episode_ids"), variant("v", "$.episodeId", "bigint").alias("episode_id"),
        _names(variant("v", "$.languages", "variant")).alias("languages"), F.transform(variant("v", "$.rejections", "array<variant>"), lambda r: F.coalesce(F.try_variant_get(r, "$.reason", "string"), F.try_variant_get(r, "$", "string"))).alias("rejections"),
    )


STREAMS = (
    "file_id string, container string, streams array<struct<index:int,stream_id:int,kind:string,codec:string,time_base:struct<num:int,den:int>,width:int,height:int,fps:struct<num:int,den:int>,"
    "bitrate:bigint,channels:int,sample_rate:int,profile:int,level:int,language:string,title:string,disposition:struct<default:boolean,forced:boolean,hearing_impaired:boolean,visual_impaired:boolean,attached_picture:boolean>>>"
)


def streams(spark: SparkSession, path: str, kind: str = "all") -> DataFrame:
    """A row a stream of JSON probe dumps, of one kind if asked."""
    return flat_streams(spark.read.schema(STREAMS).json(path), kind)


def flat_streams(probes: DataFrame, kind: str = "all") -> DataFrame:
    """The same of probe dumps that are read already."""
    from ..functions.media import rational

    rows = probes.select("file_id", "container", F.inline("streams"))
    flat = rows.withColumn("fps", rational(F.col("fps.num"), F.col("fps.den"))).withColumn("attached_picture", F.col("disposition.attached_picture"))
    return flat if kind == "all" else flat.filter(F.col("kind") == kind)


def present_languages(language: Column) -> tuple[Column, Column]:
    """Aggregates of a file's streams (kind): sorted distinct known languages of audio and of subtitles."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, language_tag(language))))
    return of("audio").alias("present_audio"), of("subtitle").alias("present_subtitles")


def language_sets(streams_: DataFrame, file: str = "file_id") -> DataFrame:
    """Sorted distinct known languages of audio and subtitle streams, a row a file."""
    return streams_.groupBy(file).agg(*present_languages(F.col("language")))


def is_bitmap(mode: str = "convert") -> Column:
    """Whether a stream (kind, codec) is a bitmap subtitle that is not skipped."""
    return (F.col("kind") == "subtitle") & F.col("codec").isin(*BITMAP_SUBTITLES) & F.lit(mode != "skip")


def bitmap_candidates(streams_: DataFrame, mode: str = "convert") -> DataFrame:
    """Bitmap subtitle streams; none if subtitles are skipped."""
    return streams_.filter(is_bitmap(mode))


def retagged(streams_: DataFrame, tag: str, missing: Column) -> DataFrame:
    """Streams without a known language tagged, in files where something is missing; ``retagged`` says which."""
    unknown = missing & F.col("kind").isin("audio", "subtitle") & language_tag(F.col("language")).isNull()
    return streams_.withColumn("retagged", F.coalesce(unknown, F.lit(False))).withColumn("language", F.when(F.col("retagged"), tag).otherwise(F.col("language")))


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their sibling JSON by stem: name, language (eng), expected text and min_similarity in [0, 1]."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[^.]+$", 1)
    images = listed(spark, folder, ".png").select(stem.alias("name"), F.col("path").alias("image"))
    raw = read_files(spark, folder, ".json").select(stem.alias("name"), F.from_json(F.col("content").cast("string"), "expected_text string, language string, min_similarity double").alias("j"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("j.min_similarity", F.lit(0.0))))
    return images.join(raw, "name").select("name", "image", F.coalesce("j.language", F.lit("eng")).alias("language"), "j.expected_text", bounded.alias("min_similarity")).orderBy("name")


def environment(spark: SparkSession, prefix: str, variables: Mapping[str, str] | None = None) -> DataFrame:
    """Variables that start with a prefix in any case, by key, secrets hidden."""
    rows = spark.createDataFrame(list((os.environ if variables is None else variables).items()) or [("", "")], "key string, value string")
    return rows.filter(F.lower("key").startswith(prefix.lower()) & (F.col("key") != "")).select("key", redacted(F.col("key"), F.col("value")).alias("value")).orderBy("key")


def first_paths(*candidates: Column) -> Column:
    """The first of some ``|``-separated settings that names a path, as an array."""
    parts = [F.filter(F.transform(F.split(c, r"\|"), strip), lambda p: p != "") for c in candidates]
    return F.coalesce(*(F.when(F.size(p) > 0, p) for p in parts), F.array().cast("array<string>"))


def library_sections(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(key, location) of the Directory nodes of an XML answer; nodes without a key or locations drop."""
    from_xml = F.from_xml(F.col(column), "Directory array<struct<_key:string,Location:array<struct<_path:string>>>>")
    return xml.select(F.explode(from_xml["Directory"]).alias("d")).select(F.col("d._key").alias("key"), F.explode("d.Location._path").alias("location")).filter("key is not null and location is not null")


def sections_of(directories: DataFrame, sections: DataFrame, directory: str = "directory") -> DataFrame:
    """Sections with a location that is the directory or above it.

    A directory has few ancestors, so they are exploded and joined by equality: no theta join.
    """
    parts = F.split(F.regexp_replace(F.col(directory), "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rooted = sections.withColumn("_root", F.regexp_replace("location", "/+$", ""))
    return directories.withColumn("_root", F.explode(above)).join(rooted, "_root").drop("_root")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table kept as one JSON array; a missing file or a corrupt one gives no rows."""
    empty = spark.createDataFrame([], schema)
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    rows = whole.select(F.explode(F.from_json("value", ArrayType(empty.schema))).alias("r"))
    return rows.select("r.*").dropna("all")


def gpu_samples(spark: SparkSession, path: str) -> DataFrame:
    """GPU readings of a CSV; rows with fewer than seven fields drop."""
    return gpu_readings(spark.read.text(path))


def gpu_readings(lines: DataFrame) -> DataFrame:
    """The same of lines (value) that are read already."""
    fields = F.transform(F.split("value", ","), strip)
    number = lambda k: fields[k].try_cast("double")
    rows = lines.filter(F.size(fields) >= 7)
    return rows.select(number(1).cast("int").alias("gpu"), number(2).alias("util"), number(4).alias("memory"), number(5).alias("power"), number(6).alias("temperature")).filter("gpu is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text logs."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("ord", "line"))


def download_plan(paths: DataFrame, kind: str, *, given: list[str] = (), suffix: str | None = None) -> DataFrame:
    """A plan row a resolved path; paths given by hand disable it, and exactly one of them is an error."""
    if len(given) == 1:
        raise ValueError("one path is neither a download event nor an input and output")
    default = ".fixed" if kind == "tv" else ""
    from ..functions.text import with_suffix

    planned = paths.select("path", with_suffix(F.col("path"), F.lit(default if suffix is None else suffix)).alias("target"))
    return planned.filter(F.lit(not given))


def dispatch(event: Column) -> Column:
    """What an event leads to: a plan for Download, else a skip with its reason."""
    name = F.lower(strip(event))
    return F.when(name == "download", F.struct(F.lit("plan").alias("step"), F.lit(None).cast("string").alias("reason"))).when(name == "test", F.struct(F.lit("skip").alias("step"), F.lit("test event").alias("reason"))).otherwise(F.struct(F.lit("skip").alias("step"), F.concat(F.lit("event "), F.coalesce(event, F.lit("(none)"))).alias("reason")))


def current_history_id(explicit: Column, history_: DataFrame, items: DataFrame, depth: int = 10) -> DataFrame:
    """(download_id, history_id): the explicit id, else the newest of the download's newest ``depth`` rows that has one, else null."""
    newest = Window.partitionBy("download_id").orderBy(F.col("date").desc_nulls_last(), F.col("id").desc())
    recent = history_.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= depth)
    chosen = recent.groupBy("download_id").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("_place"))).alias("_newest"))
    return items.join(chosen, "download_id", "left").select("download_id", F.coalesce(explicit, F.col("_newest")).alias("history_id"))


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files of a folder, in lower-case hex; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def matches_checksum(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, verdict) of expected files (name, sha256): ``ok``, ``mismatch`` or ``missing``; case and outer spaces of a sum aside."""
    found = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("sha256").alias("_found"))
    verdict = F.when(F.col("_found").isNull(), "missing").when(F.lower(strip(F.col("sha256"))) == F.col("_found"), "ok").otherwise("mismatch")
    return expected.join(found, "name", "left").select("name", verdict.alias("verdict"))
