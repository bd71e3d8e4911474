"""Queries of subtitle files, tracks, joins in time and streams, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a, word_tokens
from ..operators import cues, evaluation, joins
from ..sources import sinks, subtitles
from ..streaming import stateful
from .stand_ins import table
from .text import CIRCUIT_BREAKER, MONOTONIC_DTS, QUALITY_BASELINE

#: Words of the stand-in captions, in the order of their numbers.
WORDS = ["alpha", "beta", "gamma", "delta", "it's", "Ok"]


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the captions of users' files: n-th caption of a file, with its words."""
    place = Window.partitionBy("file").orderBy("event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("file"), "event_id")
    word = lambda n: F.element_at(F.array(*map(F.lit, WORDS)), (n % 6 + 1).cast("int"))
    return e.withColumn("n", F.row_number().over(place)).withColumn("a", word(F.col("event_id"))).withColumn("b", word(F.floor(F.col("event_id") / 7)))


_CAPTIONS_SQL = f"""c AS (SELECT user_id AS file, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {WORDS!r}[(event_id % 6 + 1)::INT] AS a, {WORDS!r}[(event_id // 7 % 6 + 1)::INT] AS b FROM events)""".replace('"it\'s"', "'it''s'")


def _srt(spark: SparkSession, sf: str) -> DataFrame:
    """SRT texts: captions 0 mod 4 have no blank line after them, 1 mod 4 a blank line before their text, 2 mod 4 one within."""
    stamp = lambda ms: cues.time_text(ms)
    start = F.col("n") * 5000
    head = F.concat(F.col("n").cast("string"), F.lit("\r\n"), stamp(start), F.lit("  --> "), stamp(start + 2000), F.lit(" X1:0\r\n"))
    shape = F.expr("n % 4")
    body = F.concat(F.when(shape == 1, "\r\n").otherwise(""), F.col("a"), F.lit("  "), F.when(shape == 2, "\r\n\r\n").otherwise(F.lit("\r\n")), F.col("b"), F.when(shape == 0, "\r\n").otherwise("\r\n\r\n"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(head, body).alias("t")))), lambda s: s["t"]), "")
    return _captions(spark, sf).groupBy("file").agg(F.concat(F.lit("﻿"), texts).alias("text"))


def srt_cues(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.srt_cues(_srt(spark, sf)).select("file", "ord", "start_ms", "end_ms", "text")


SRT_CUES = f"""WITH {_CAPTIONS_SQL}, p AS (SELECT file, n, 0 AS part, n * 5000 AS s, CASE WHEN n % 4 = 2 THEN a ELSE a || ' ' || b END AS text FROM c UNION ALL SELECT file, n, 1, NULL, b FROM c WHERE n % 4 = 2)
SELECT file, (row_number() OVER (PARTITION BY file ORDER BY n, part) - 1)::INT AS ord, s AS start_ms, s + 2000 AS end_ms, text FROM p"""


def srt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = subtitles.srt_tokens(_srt(spark, sf))
    return t.select("file", F.size("tokens").cast("long").alias("tokens"), F.md5(F.encode(F.array_join("tokens", " "), "UTF-8")).alias("digest"), "cues")


SRT_TOKENS = f"""WITH {_CAPTIONS_SQL} SELECT file, 2 * count(*) AS tokens, md5(string_agg(a || ' ' || b, ' ' ORDER BY n)) AS digest, count(*) AS cues FROM c GROUP BY file"""


def _tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Captions as a reference track, and a hypothesis in which every fifth is missing, every third differs and text moves on."""
    own = _captions(spark, sf).select(F.col("file").alias("track_id"), F.col("n").alias("ord"), (F.col("n") * 5000).alias("start_ms"), (F.col("n") * 5000 + 2000).alias("end_ms"), F.concat_ws(" ", "a", "b").alias("text"), "a", "b")
    heard = own.filter("ord % 5 <> 0").withColumn("text", F.expr("case when ord % 3 = 0 then concat(a, ' Ok ', b) when ord % 3 = 1 then a else concat('gamma ', b) end"))
    return own.drop("a", "b"), heard.drop("a", "b").withColumn("start_ms", F.col("start_ms") + 300).withColumn("end_ms", F.col("end_ms") + 300)


_TRACKS_SQL = f"""{_CAPTIONS_SQL}, t AS (SELECT file AS track_id, n, a || ' ' || b AS r, CASE WHEN n % 5 = 0 THEN '' WHEN n % 3 = 0 THEN a || ' Ok ' || b WHEN n % 3 = 1 THEN a ELSE 'gamma ' || b END AS h FROM c)"""


def aligned_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return cues.align(*_tracks(spark, sf), bin_ms=5000).select("track_id", "ref_ord", "hyp_ord", "overlap", "delta", "ref_text", "hyp_text")


ALIGNED_TRACKS = f"""WITH {_TRACKS_SQL} SELECT track_id, n AS ref_ord, CASE WHEN n % 5 <> 0 THEN n END AS hyp_ord, CASE WHEN n % 5 <> 0 THEN 1700 END::BIGINT AS overlap, CASE WHEN n % 5 <> 0 THEN 300 END::BIGINT AS delta, r AS ref_text, CASE WHEN n % 5 <> 0 THEN h END AS hyp_text FROM t"""


def track_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates of whole tracks, as the acceptance gate takes them."""
    r = evaluation.roll_up(cues.align(*_tracks(spark, sf), bin_ms=5000))
    return r.select("track_id", "reference_words", "hypothesis_words", "reference_chars", "hypothesis_chars", "word_edits", "char_edits", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "accepted")


_LETTERS = "replace(" * 6 + "{}" + "".join(f", '{w.lower().replace(chr(39), chr(39) * 2)}', '{k}')" for k, w in zip("uvwxyz", WORDS, strict=True))
TRACK_RATES = f"""WITH {_TRACKS_SQL}, j AS (SELECT track_id, string_agg(r, ' ' ORDER BY n) AS r, trim(regexp_replace(string_agg(h, ' ' ORDER BY n), ' +', ' ', 'g')) AS h FROM t GROUP BY track_id),
w AS (SELECT *, replace({_LETTERS.format("lower(r)")}, ' ', '') AS rw, replace({_LETTERS.format("lower(h)")}, ' ', '') AS hw FROM j), e AS (SELECT *, levenshtein(rw, hw) AS we, levenshtein(r, h) AS ce FROM w)
SELECT track_id, length(rw) AS reference_words, length(hw) AS hypothesis_words, length(r) AS reference_chars, length(h) AS hypothesis_chars, we AS word_edits, ce AS char_edits, round(we / length(rw), 6) AS wer, round(ce / length(r), 6) AS cer, ce / length(r) <= 0.02 AND we / length(rw) <= 0.08 AS accepted FROM e"""


def wer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Word error rates and similarities of part names against the next part's."""
    p = table(spark, sf, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    a, b = word_tokens(F.col("p_name")), word_tokens(F.col("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(evaluation.error_rate(a, b), 6).alias("wer"), F.round(evaluation.line_similarity(a, b), 6).alias("similarity"))


WER_PAIRS = r"""WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\p{L}\p{M}\p{Nd}\p{Pc}'']+|[^\p{L}\p{M}\p{Nd}\p{Pc}''\s]') AS t FROM part), v AS (SELECT list_sort(list(DISTINCT w)) AS words FROM (SELECT unnest(t) AS w FROM p)),
s AS (SELECT p_partkey, array_to_string(list_transform(t, lambda w: chr((20000 + list_position(words, w))::INT)), '') AS s FROM p, v), j AS (SELECT a.p_partkey, a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS e FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE e / length(a) END, 6) AS wer, round(greatest(0.0, 1 - e / greatest(length(a), length(b), 1)), 6) AS similarity FROM j"""


def label_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("hash"))


LABEL_HASHES = """WITH b AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::UHUGEINT) AS codes FROM part)
SELECT p_partkey, format('{:016x}', list_reduce(list_prepend(14695981039346656037::UHUGEINT, codes), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS hash FROM b"""


def progress_reports(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), (F.col("event_id") / 100).alias("percent"))
    return cues.progress(own)


PROGRESS_REPORTS = """WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS ord, event_id / 100 AS percent FROM events),
r(job_id, ord, percent) AS (SELECT DISTINCT job_id, -1::BIGINT, 0.0::DOUBLE FROM e UNION ALL
  SELECT job_id, min(ord), min(percent) FROM (SELECT r.job_id, e.ord, e.percent FROM r JOIN e ON e.job_id = r.job_id AND e.ord > r.ord AND (e.percent >= r.percent + 5 OR e.percent >= 100 AND r.percent < 100)) GROUP BY job_id)
SELECT job_id, ord, percent FROM r WHERE ord >= 0"""


def approximations(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate counts and medians, held against the exact ones: within eight percent of the count, and five of the ranks."""
    e = table(spark, sf, "events")
    near = lambda approx, exact, by: F.abs(approx - exact) <= by * F.abs(exact) + 1e-9
    rank = F.count_if(F.col("value") <= F.col("median")) / F.count("value")
    medians = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median"))
    users = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))  # beside the sketches it would keep one of each a user
    ranked = e.join(medians.select("event_type", "median"), "event_type").groupBy("event_type").agg(rank.alias("rank"))
    return medians.join(users, "event_type").join(ranked, "event_type").select("event_type", "exact", near(F.col("users"), F.col("exact"), 0.08).alias("users_near"), near(F.col("rank"), F.lit(0.5), 0.05).alias("median_near"))


APPROXIMATIONS = "SELECT event_type, count(DISTINCT user_id) AS exact, true AS users_near, true AS median_near FROM events GROUP BY event_type"


def as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the user's last view before it."""
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"), F.col("value").alias("viewed"))
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.as_of(bought, views, by=["user_id"], at="ts", order=("event_id",), keep=["view_id", "viewed"]).select("event_id", "view_id", F.round("viewed", 6).alias("viewed"))


AS_OF = """SELECT event_id, view_id, round(viewed, 6) AS viewed FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS view_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS viewed
  FROM events WHERE event_type IN ('purchase', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_type = 'purchase'"""


def range_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events within ranges of other events' numbers, of the same user."""
    e = table(spark, sf, "events")
    points = e.select("user_id", F.col("event_id").alias("at"))
    ranges = e.select("user_id", F.col("event_id").alias("begin"), (F.col("event_id") + F.col("event_id") % 1000).alias("end"))
    return joins.range_join(points, ranges, by=["user_id"], at="at", begin="begin", end="end", width=500.0).groupBy("user_id").agg(F.count("*").alias("n"))


RANGE_COUNTS = "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id >= b.event_id AND a.event_id < b.event_id + b.event_id % 1000 GROUP BY a.user_id"


def rollup_counts(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return made


ROLLUP_COUNTS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::INT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


SLIDING_WINDOWS = """WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), w AS (SELECT d AS s, event_type FROM d UNION ALL SELECT d - 1, event_type FROM d)
SELECT strftime(s, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM w GROUP BY ALL"""


def join_hints(spark: SparkSession, sf: str) -> DataFrame:
    """One join by each strategy; the dimension is broadcast behind a count of its rows."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    by = lambda strategy: o.join(joins.hinted(c, strategy), F.col("o_custkey") == F.col("c_custkey")).join(joins.hinted(n, "broadcast"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(strategy))
    return by("merge").unionByName(by("shuffle_hash")).unionByName(by("broadcast"))


JOIN_HINTS = "SELECT n_name, count(*) AS n, strategy FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, (VALUES ('merge'), ('shuffle_hash'), ('broadcast')) s(strategy) GROUP BY n_name, strategy"


def kept_table(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table written twice and read back: the newest row of each key, and the last two versions."""
    folder = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("checked_at"), "event_type")
    schema = "key string, checked_at bigint, event_type string"
    for part in range(3):
        sinks.write_table(sinks.upsert(sinks.read_table(spark, folder, schema), rows.filter(F.col("checked_at") % 3 == part), "key", "checked_at"), folder)
    return sinks.read_table(spark, folder, schema).withColumn("versions", F.lit(len(sinks.versions(spark, folder))))


KEPT_TABLE = "SELECT 'k' || user_id AS key, max(event_id) AS checked_at, arg_max(event_type, event_id) AS event_type, 2 AS versions FROM events GROUP BY user_id"


def _folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where it names none and is local itself."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp(prefix="cuewright-")


def in_parts(spark: SparkSession, sf: str, through: Callable[[DataFrame], DataFrame], part: Column, parts: int, last: DataFrame | None = None) -> DataFrame:
    """What a streaming operator appends over the events that come in ``parts`` parts, one after the other.

    Each part is a run of its own from the checkpoint, so state is read back from it; ``last`` is a further part.
    """
    root = f"{_folder(spark)}/parts-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    for k in range(parts + (last is not None)):
        own = events.filter(part == k) if k < parts else last
        own.write.mode("append").parquet(f"{root}/in")
        made = through(spark.readStream.schema(events.schema).parquet(f"{root}/in"))
        query = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


def streamed(spark: SparkSession, sf: str, through: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """The same with parts by number, so that a stream's rows come in their order."""
    most = table(spark, sf, "events").agg(F.max("event_id").alias("m")).first().m or 0
    return in_parts(spark, sf, through, F.floor(F.col("event_id") * parts / (most + 1)), parts)


def stream_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    packets = lambda e: e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 97).alias("dts"), (F.col("event_id") % 101).alias("pts"))
    return streamed(spark, sf, lambda e: stateful.monotonic(packets(e))).select("stream_id", "ord", "new_dts", "new_pts")


def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    packets = lambda e: e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("failed"))
    out = streamed(spark, sf, lambda e: stateful.breaker(packets(e)))
    return out.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "skip").alias("failures"))


def stream_baseline(spark: SparkSession, sf: str) -> DataFrame:
    samples = lambda e: e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 110 / 100).alias("quality"), (F.col("event_id") % 90 / 100).alias("confidence"), (F.col("event_id") % 200_000).alias("t_ms"))
    return streamed(spark, sf, lambda e: stateful.baseline(samples(e))).select("stream_id", "ord", "samples", F.round("min_quality", 10).alias("min_quality"), F.round("min_confidence", 10).alias("min_confidence"))


def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of users' streams, flushed at each error: tails shorter than a frame are written there."""
    packets = lambda e: e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 700).alias("samples"), (F.col("event_type") == "error").alias("flush"))
    return streamed(spark, sf, lambda e: stateful.rechunk(packets(e)))


STREAM_FRAMES = """WITH e AS (SELECT user_id AS stream_id, event_id, event_id % 700 AS samples, event_type = 'error' AS flush FROM events),
s AS (SELECT *, coalesce(sum(flush::INT) OVER (PARTITION BY stream_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
t AS (SELECT stream_id, part, sum(samples)::BIGINT AS total, bool_or(flush) AS flushed FROM s GROUP BY stream_id, part),
f AS (SELECT stream_id, part, unnest([least(1024, total - k * 1024) for k in range(0, CASE WHEN flushed THEN (total + 1023) // 1024 ELSE total // 1024 END)]) AS n, generate_subscripts([k for k in range(0, CASE WHEN flushed THEN (total + 1023) // 1024 ELSE total // 1024 END)], 1) AS place FROM t)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY part, place) - 1 AS frame, n::BIGINT AS n FROM f"""


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    reports = lambda e: e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), (F.col("event_id") / 100).alias("percent"))
    return streamed(spark, sf, lambda e: stateful.progress(reports(e)))


def stream_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of keys a day apart by number, none of which finds anything: one in three days may run."""
    searches = lambda e: e.select(F.concat(F.lit("k"), (F.col("event_id") % 30).cast("string")).alias("key"), F.col("event_id").alias("ord"), (F.floor(F.col("event_id") / 30) * 86400).alias("at"), F.lit(False).alias("found"))
    return streamed(spark, sf, lambda e: stateful.cooldowns(searches(e), 3)).select("key", "ord", "allowed")


STREAM_COOLDOWNS = """WITH RECURSIVE e AS (SELECT 'k' || (event_id % 30) AS key, event_id AS ord, event_id // 30 AS day FROM events),
r(key, day) AS (SELECT key, min(day) FROM e GROUP BY key UNION ALL SELECT key, min(day) FROM (SELECT r.key, e.day FROM r JOIN e ON e.key = r.key AND e.day >= r.day + 3) GROUP BY key)
SELECT e.key, ord, r.day IS NOT NULL AS allowed FROM e LEFT JOIN r ON r.key = e.key AND r.day = e.day"""


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has passed, counted by kind."""
    out = streamed(spark, sf, lambda e: stateful.windowed_counts(e, late="1 hour").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"))
    newest = table(spark, sf, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("newest"))
    return out.crossJoin(F.broadcast(newest)).filter(F.col("day") < F.date_sub(F.col("newest").cast("date"), 1).cast("string")).drop("newest")  # one row


STREAM_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) - 1 FROM events) GROUP BY ALL"


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Days counted where half of the events come late, a third of the whole time behind: those of days that are closed by then drop."""
    most = table(spark, sf, "events").agg(F.max("event_id").alias("m")).first().m or 0
    part = F.floor(F.col("event_id") * 3 / (most + 1)) + F.when(F.col("event_id") % 2 == 1, 1).otherwise(0)
    counted = lambda e: stateful.windowed_counts(e, late="5 days").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return in_parts(spark, sf, counted, part, 4)


STREAM_LATE = """WITH m AS (SELECT max(event_id) AS m FROM events), e AS (SELECT event_type, ts, CAST(ts AS DATE) AS day, event_id * 3 // (m + 1) + event_id % 2 AS part FROM events, m),
w AS (SELECT k AS part, date_trunc('milliseconds', max(ts)) - INTERVAL 5 DAY AS mark FROM e, range(0, 4) r(k) WHERE part <= k GROUP BY k),
a AS (SELECT e.* FROM e LEFT JOIN w ON w.part = e.part - 1 WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM a WHERE day + INTERVAL 1 DAY <= (SELECT max(mark) FROM w) GROUP BY ALL"""


def stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets of the streams that suppliers stand for, counted by kind; those of other streams drop."""
    contexts = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("stream_id"), F.expr("case s_suppkey % 2 when 0 then 'video' else 'audio' end").alias("kind"))
    packets = lambda e: e.select((F.col("user_id") % 50).alias("stream_id"), F.col("event_id").alias("ord"))
    out = streamed(spark, sf, lambda e: stateful.routed(packets(e), contexts))
    return out.groupBy("stream_id", "kind").agg(F.count("*").alias("n"), F.max("ord").alias("last"))


STREAM_ROUTES = "SELECT s_suppkey AS stream_id, CASE s_suppkey % 2 WHEN 0 THEN 'video' ELSE 'audio' END AS kind, count(*) AS n, max(event_id) AS last FROM events JOIN supplier ON s_suppkey = user_id % 50 WHERE s_suppkey % 3 <> 0 GROUP BY s_suppkey"


QUERIES = {
    "srt_cues": (srt_cues, SRT_CUES),
    "srt_tokens": (srt_tokens, SRT_TOKENS),
    "aligned_tracks": (aligned_tracks, ALIGNED_TRACKS),
    "track_rates": (track_rates, TRACK_RATES),
    "wer_pairs": (wer_pairs, WER_PAIRS),
    "label_hash": (label_hashes, LABEL_HASHES),
    "progress_reports": (progress_reports, PROGRESS_REPORTS),
    "approximations": (approximations, APPROXIMATIONS),
    "as_of_join": (as_of, AS_OF),
    "range_join": (range_counts, RANGE_COUNTS),
    "rollup_counts": (rollup_counts, ROLLUP_COUNTS),
    "sliding_windows": (sliding_windows, SLIDING_WINDOWS),
    "join_hints": (join_hints, JOIN_HINTS),
    "kept_table": (kept_table, KEPT_TABLE),
    "stream_monotonic": (stream_monotonic, MONOTONIC_DTS),
    "stream_breaker": (stream_breaker, CIRCUIT_BREAKER),
    "stream_baseline": (stream_baseline, QUALITY_BASELINE),
    "stream_frames": (stream_frames, STREAM_FRAMES),
    "stream_progress": (stream_progress, PROGRESS_REPORTS),
    "stream_cooldowns": (stream_cooldowns, STREAM_COOLDOWNS),
    "stream_windows": (stream_windows, STREAM_WINDOWS),
    "stream_late": (stream_late, STREAM_LATE),
    "stream_routes": (stream_routes, STREAM_ROUTES),
}
