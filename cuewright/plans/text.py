"""Queries of texts, cues, scores and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.codepoints import collapsed_texts, normalised_texts
from ..functions.recognition import likelihood
from ..operators import cues, evaluation, routing, telemetry
from ..sources.subtitles import srt_text
from ..streaming.stateful import baseline_batch, breaker_batch, rechunk_batch
from .stand_ins import CUES_SQL, table
from .stand_ins import cues as cue_frame

#: Letter groups that the likelihood query counts as common; any list will do.
PAIRS, TRIPLES = ["th", "he", "in", "er", "an", "re", "on", "en", "at", "es"], ["the", "ing", "and", "her", "ere", "ent", "tha"]


def language_tags(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select(F.concat("lang", F.lit("-XX")).alias("t"))
    return own.groupBy(T.language_tag(F.col("t")).alias("tag"), T.recogniser_language(F.col("t")).alias("model")).agg(F.count("*").alias("n"))


LANGUAGE_TAGS = """SELECT CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END AS tag, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END AS model, count(*) AS n FROM documents GROUP BY ALL"""


def routing_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", routing.profile(F.col("lang")).alias("profile")).agg(F.count("*").alias("n"))


ROUTING_PROFILES = "SELECT lang, CASE WHEN lang = 'en' THEN 'english' ELSE 'latin' END AS profile, count(*) AS n FROM documents GROUP BY ALL"


def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", normalised_texts(F.col("text")).alias("t"), collapsed_texts(F.col("text")).alias("e"))
    return own.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("lines"), F.md5(F.encode("e", "UTF-8")).alias("collapsed"))


TEXT_NORMALISE = r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS lines,
  md5(regexp_replace(regexp_replace(replace(translate(text, '“”‘’', '""''''' ), '…', '...'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS collapsed FROM documents"""


def font_tags(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit("<font color=red>"), F.col("html"), F.lit("</FONT>"))
    return table(spark, sf, "pages").select("page_id", F.md5(F.encode(T.strip_font_tags(wrapped), "UTF-8")).alias("digest"), T.percent_encode(F.col("url")).alias("url"))


FONT_TAGS = r"""SELECT page_id, md5(regexp_replace('<font color=red>' || html || '</FONT>', '<\s*/?font([ \t][^>]*)?>', '', 'gi')) AS digest, url_encode(url) AS url FROM pages"""


def bit_rates(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(cast(p_size as string), case p_partkey % 5 when 0 then 'M' when 1 then ' kbps' when 2 then 'mbit/s' when 3 then '' else 'x' end)")
    return table(spark, sf, "part").select("p_partkey", T.bits_per_second(raw).alias("bps"), T.file_name_part(F.concat("p_name", F.lit(":/?"))).alias("name"))


BIT_RATES = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000000 WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1000000 WHEN 3 THEN p_size END::BIGINT AS bps, trim(p_name) || '---' AS name FROM part"""


def quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.expr("concat('Film.', case p_size % 4 when 0 then '1080p' when 1 then '720P' when 2 then 'x1080p' else '2160p.480p' end, '.', p_partkey)")
    return table(spark, sf, "part").select("p_partkey", T.quality_label(stem, F.lit(720)).alias("stem"), T.with_suffix(F.concat(stem, F.lit(".mkv")), F.lit("fixed")).alias("path"))


QUALITY_LABELS = """WITH s AS (SELECT p_partkey, p_size % 4 AS k, 'Film.' || CASE p_size % 4 WHEN 0 THEN '1080p' WHEN 1 THEN '720P' WHEN 2 THEN 'x1080p' ELSE '2160p.480p' END || '.' || p_partkey AS stem FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Film.720p.' || p_partkey WHEN 1 THEN 'Film.720p.' || p_partkey ELSE stem END AS stem, stem || '.fixed.mkv' AS path FROM s"""


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).alias("n"))


TOKEN_COUNTS = r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}'']+|[^\p{L}\p{M}\p{Nd}\p{Pc}''\s]'))::INT AS n FROM documents"""


def ngram_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(likelihood(F.col("p_name"), PAIRS, TRIPLES), 6).alias("score"))


def ngram_sql() -> str:
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS w, length(regexp_replace(lower(p_name), '[a-z'']', '', 'g')) AS bad FROM part),
s AS (SELECT *, list_sum(list_transform(range(1, length(w)), lambda i: CASE WHEN w[i:i + 1] IN ({listed(PAIRS)}) THEN 1.0::DOUBLE ELSE -0.65 END)) AS b, list_sum(list_transform(range(1, length(w) - 1), lambda i: CASE WHEN w[i:i + 2] IN ({listed(TRIPLES)}) THEN 1.3::DOUBLE ELSE -0.85 END)) AS t FROM p)
SELECT p_partkey, round(CASE WHEN length(w) < 2 THEN -6.0::DOUBLE - bad * 2.4 ELSE greatest((b + coalesce(t, 0)) / (length(w) - 1 + greatest(length(w) - 2, 0)) - CASE WHEN length(w) < 4 THEN 0.45 ELSE 0.0 END - bad * 2.4, -6.0) END, 6) AS score FROM s"""


def cer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(evaluation.char_error_rate(T.stripped_upper(F.col("p_name")), T.stripped_upper(F.col("p_type"))), 6).alias("cer"), F.round(evaluation.training_error_rate(F.col("p_name"), F.col("p_type")), 6).alias("training_cer"))


CER_PAIRS = r"""WITH p AS (SELECT p_partkey, p_name, p_type, upper(regexp_replace(p_name, '\s+', '', 'g')) AS a, upper(regexp_replace(p_type, '\s+', '', 'g')) AS b FROM part)
SELECT p_partkey, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(a, b) / length(a) END, 6) AS cer, round(levenshtein(p_name, p_type) / greatest(length(p_name), 1), 6) AS training_cer FROM p"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select(
        F.col("lang").alias("language"), (F.col("n_chars") % 100 / 100).alias("cer"), (F.col("doc_id") % 50 / 50).alias("wer"), (F.col("n_chars") % 7).cast("double").alias("infer_ms"), F.expr("doc_id % 5 = 0").alias("low"),
    )
    scored = own.withColumn("similarity", evaluation.fixture_similarity(F.col("cer"), F.col("wer"))).withColumn("meets_threshold", F.col("similarity") >= 0.5)
    return evaluation.with_modes(scored).withColumn("used_fallback", evaluation.replaces(F.when(F.col("low"), 0.1).otherwise(0.9), F.lit(0.9), F.lit(0.8), F.col("min_gain"), F.lit(False), F.lit(False)))


def mode_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.summarise_modes(_results(spark, sf))
    return s.select("mode", "language", "fixture_count", *(F.round(c, 6).alias(c) for c in ("avg_cer", "avg_wer", "avg_similarity", "pass_rate", "avg_infer_ms")), "replacements", "whole_mode")


MODE_SUMMARY = """WITH r AS (SELECT lang AS language, mode, n_chars % 100 / 100.0 AS cer, doc_id % 50 / 50.0 AS wer, (n_chars % 7)::DOUBLE AS infer_ms, doc_id % 5 = 0 AND mode = 'hybrid' AS used FROM documents, (VALUES ('pure'), ('hybrid'), ('strict')) m(mode)),
s AS (SELECT *, greatest(0.0, least(1.0, greatest(1 - cer, 1 - wer)))::DOUBLE AS similarity FROM r)
SELECT mode, language, count(*) AS fixture_count, round(avg(cer), 6) AS avg_cer, round(avg(wer), 6) AS avg_wer, round(avg(similarity), 6) AS avg_similarity, round(avg(CASE WHEN similarity >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(infer_ms), 6) AS avg_infer_ms,
  count(*) FILTER (used) AS replacements, grouping(language)::INT AS whole_mode FROM s GROUP BY GROUPING SETS ((mode), (mode, language))"""


def worst_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("ref_ord"), F.col("doc_id").alias("hyp_ord"), (F.col("n_chars") % 101 / 101).alias("similarity"))
    return evaluation.worst(pairs, 8).select("ref_ord", F.round("similarity", 6).alias("similarity"))


WORST_PAIRS = "SELECT doc_id AS ref_ord, round((n_chars % 101) / 101.0, 6) AS similarity FROM documents ORDER BY (n_chars % 101), doc_id LIMIT 8"


def aligned_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Even events as a reference track, odd ones as the hypothesis, aligned in time."""
    own = cue_frame(spark, sf).withColumn("end_ms", F.col("start_ms") + 1_200_000 * (F.col("ord") % 60))
    pairs = cues.align(own.filter("ord % 2 = 0"), own.filter("ord % 2 = 1"), bin_ms=14_400_000)
    return pairs.select("track_id", "ref_ord", "hyp_ord", "overlap", "delta")


#: Reference cues are taken one after the other; each step picks the best hypothesis cue that no step before has used.
CUE_ALIGN = f"""WITH RECURSIVE {CUES_SQL}, own AS (SELECT track_id, ord, start_ms AS a, start_ms + 1200000 * (ord % 60) AS b FROM cues),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ord) AS n FROM own WHERE ord % 2 = 0), h AS (SELECT * FROM own WHERE ord % 2 = 1),
p AS (SELECT r.track_id, n, h.ord AS hyp_ord, greatest(least(r.b, h.b) - greatest(r.a, h.a), 0) AS overlap, abs(r.a - h.a) AS delta FROM r JOIN h ON r.track_id = h.track_id WHERE least(r.b, h.b) > greatest(r.a, h.a) OR abs(r.a - h.a) <= {cues.TOLERANCE_MS}),
m AS (SELECT track_id, max(n) AS most FROM r GROUP BY track_id),
s(track_id, n, used, hyp_ord, overlap, delta) AS (SELECT track_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM m
  UNION ALL SELECT track_id, n + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.hyp_ord) END, best.hyp_ord, best.overlap, best.delta FROM (
    SELECT s.track_id, s.n, s.used, arg_min(struct_pack(hyp_ord := p.hyp_ord, overlap := p.overlap, delta := p.delta), struct_pack(a := -p.overlap, b := p.delta, c := p.hyp_ord)) AS best
    FROM s JOIN m ON m.track_id = s.track_id AND s.n < m.most LEFT JOIN p ON p.track_id = s.track_id AND p.n = s.n + 1 AND NOT list_contains(s.used, p.hyp_ord) GROUP BY s.track_id, s.n, s.used))
SELECT r.track_id, r.ord AS ref_ord, hyp_ord, overlap, delta FROM r JOIN s ON s.track_id = r.track_id AND s.n = r.n
UNION ALL SELECT track_id, NULL, ord, NULL, NULL FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.track_id = h.track_id AND s.hyp_ord = h.ord)"""


def cue_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return cues.sanitise(cue_frame(spark, sf)).select("track_id", "ord", "start_ms", "end_ms")


CUE_TRUNCATE = f"""WITH {CUES_SQL}, n AS (SELECT *, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, ord), end_ms)) AS e FROM cues)
SELECT track_id, ord, start_ms, e AS end_ms FROM n WHERE e > start_ms AND trim(text) <> ''"""


def srt_digests(spark: SparkSession, sf: str) -> DataFrame:
    return srt_text(cue_frame(spark, sf).filter("text <> ' '")).select("track_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


SRT_DIGESTS = f"""WITH {CUES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, ord) AS n FROM cues WHERE text <> ' '),
t AS (SELECT *, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS a, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS b FROM n)
SELECT track_id, md5(string_agg(n || chr(10) || a || ' --> ' || b || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS digest FROM t GROUP BY track_id"""


def monotonic_dts(spark: SparkSession, sf: str) -> DataFrame:
    packets = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 97).alias("dts"), (F.col("event_id") % 101).alias("pts"))
    return cues.strictly_increasing(packets).select("stream_id", "ord", "new_dts", "new_pts")


MONOTONIC_DTS = """WITH p AS (SELECT user_id AS stream_id, event_id AS ord, event_id % 97 AS dts, event_id % 101 AS pts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
m AS (SELECT *, max(dts - n) OVER (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING) + n AS new_dts FROM p)
SELECT stream_id, ord, new_dts, CASE WHEN new_dts > dts THEN greatest(pts, new_dts) ELSE pts END AS new_pts FROM m"""


def fallback_pts(spark: SparkSession, sf: str) -> DataFrame:
    packets = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), F.expr("case when event_id % 7 = 0 then event_id * 10 end").alias("subtitle_pts"), F.expr("case when event_id % 5 = 0 then event_id * 11 end").alias("packet_pts"))
    return cues.subtitle_pts(packets).select("stream_id", "ord", "pts_out")


FALLBACK_PTS = """WITH p AS (SELECT user_id AS stream_id, event_id AS ord, coalesce(CASE WHEN event_id % 7 = 0 THEN event_id * 10 END, CASE WHEN event_id % 5 = 0 THEN event_id * 11 END) AS own FROM events),
r AS (SELECT *, count(own) OVER (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, run ORDER BY ord) - 1 AS since, first_value(own) OVER (PARTITION BY stream_id, run ORDER BY ord) AS start FROM r)
SELECT stream_id, ord, coalesce(start + since, since) AS pts_out FROM n"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 110 / 100).alias("quality"), (F.col("event_id") % 90 / 100).alias("confidence"), (F.col("event_id") % 200_000).alias("t_ms"))


def quality_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_batch(_samples(spark, sf)).select("stream_id", "ord", "samples", F.round("min_quality", 10).alias("min_quality"), F.round("min_confidence", 10).alias("min_confidence"))


QUALITY_BASELINE = """WITH s AS (SELECT user_id AS stream_id, event_id AS ord, (event_id % 110) / 100.0::DOUBLE AS q, (event_id % 90) / 100.0::DOUBLE AS c, event_id % 110 <= 100 AND event_id % 200000 <= 180000 AS ok FROM events),
r AS (SELECT *, count(*) FILTER (ok) OVER w AS n, avg(q) FILTER (ok) OVER w AS aq, avg(c) FILTER (ok) OVER w AS ac FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT stream_id, ord, n AS samples, CASE WHEN n >= 12 THEN round(aq * 0.85::DOUBLE, 10) END AS min_quality, CASE WHEN n >= 12 THEN round(ac * 0.85::DOUBLE, 10) END AS min_confidence FROM r"""


def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    packets = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("failed"))
    return breaker_batch(packets).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))


CIRCUIT_BREAKER = """WITH b AS (SELECT user_id, event_type = 'error' AS failed, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM events)
SELECT user_id AS stream_id, count(*) AS n, count(*) FILTER (failed) AS failures FROM b WHERE open = 0 GROUP BY user_id"""


def audio_frames(spark: SparkSession, sf: str) -> DataFrame:
    packets = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 700).alias("samples"))
    return rechunk_batch(packets)


AUDIO_FRAMES = """WITH t AS (SELECT user_id AS stream_id, sum(event_id % 700)::BIGINT AS total FROM events GROUP BY user_id)
SELECT stream_id, frame, least(1024, total - frame * 1024) AS n FROM (SELECT stream_id, total, unnest(range(0, CAST(ceil(total / 1024.0) AS BIGINT))) AS frame FROM t WHERE total > 0)"""


def gpu_summary(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.gpu_summary(table(spark, sf, "events").select((F.col("user_id") % 4).alias("gpu"), (F.col("event_id") % 101).cast("double").alias("util")))


GPU_SUMMARY = """WITH s AS (SELECT user_id % 4 AS gpu, (event_id % 101)::DOUBLE AS v FROM events), o AS (SELECT gpu, list(v ORDER BY v) AS l FROM s GROUP BY gpu)
SELECT gpu, len(l) AS n, round(list_avg(l), 2) AS mean, round(list_median(l), 2) AS median, round(l[greatest(1, CAST(floor(len(l) * 0.95) AS BIGINT))], 2) AS p95, round(list_max(l), 2) AS max FROM o"""


def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("text"))
    m = telemetry.text_metrics(lines, "lang")
    return m.withColumn("space_rate", F.round("space_rate", 8))


TEXT_METRICS = r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS s FROM documents), t AS (SELECT lang, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w FROM l)
SELECT lang, count(s) AS line_count, sum(length(s))::BIGINT AS char_count, sum(length(s) - length(replace(s, ' ', '')))::BIGINT AS space_count, sum(len(w))::BIGINT AS word_count, sum(len(list_filter(w, lambda x: length(x) >= 14)))::BIGINT AS long_token_count,
  coalesce(max(list_max(list_transform(w, lambda x: length(x)))), 0)::INT AS max_token_len, round(sum(length(s) - length(replace(s, ' ', ''))) / sum(length(s)), 8) AS space_rate FROM t GROUP BY lang"""


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.frames import throughput as rates

    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("packets"), (F.col("o_orderkey") % 5).cast("double").alias("seconds"), F.lit(60.0).alias("duration"), F.lit(10.0).alias("base_seconds"))
    return rates(runs).select("o_orderkey", *(F.round(c, 4).alias(c) for c in ("fps", "realtime", "speedup")))


THROUGHPUT = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / (o_orderkey % 5), 4) ELSE 0.0 END AS fps, CASE WHEN o_orderkey % 5 > 0 THEN round(60.0::DOUBLE / (o_orderkey % 5), 4) ELSE 0.0 END AS realtime, CASE WHEN o_orderkey % 5 > 0 THEN round(10.0::DOUBLE / (o_orderkey % 5), 4) ELSE 0.0 END AS speedup FROM orders"""


def weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("n"), F.col("l_discount").alias("loss"))
    return evaluation.epoch_means(b, "loss").withColumn("loss", F.round("loss", 8))


WEIGHTED_MEANS = "SELECT l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS loss FROM lineitem GROUP BY l_linenumber"


def repeat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("step"), (F.col("event_id") % 3).alias("symbol"))
    return cues.greedy_decode(own).select("sequence_id", F.md5(F.array_join(F.transform("symbols", lambda s: s.cast("string")), "")).alias("digest"), F.size("symbols").alias("n"))


REPEAT_COLLAPSE = """WITH l AS (SELECT user_id, event_id, event_id % 3 AS s, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id AS sequence_id, md5(coalesce(string_agg(s::VARCHAR, '' ORDER BY event_id) FILTER (s <> 0 AND (b IS NULL OR b <> s)), '')) AS digest, (count(*) FILTER (s <> 0 AND (b IS NULL OR b <> s)))::INT AS n FROM l GROUP BY user_id"""


QUERIES = {
    "lang_normalise": (language_tags, LANGUAGE_TAGS),
    "routing_profile": (routing_profiles, ROUTING_PROFILES),
    "text_normalise": (text_normalise, TEXT_NORMALISE),
    "font_tag_strip": (font_tags, FONT_TAGS),
    "bit_rates": (bit_rates, BIT_RATES),
    "quality_labels": (quality_labels, QUALITY_LABELS),
    "token_counts": (token_counts, TOKEN_COUNTS),
    "ngram_score": (ngram_scores, ngram_sql()),
    "cer_pairs": (cer_pairs, CER_PAIRS),
    "mode_language_summary": (mode_summary, MODE_SUMMARY),
    "worst_k": (worst_pairs, WORST_PAIRS),
    "cue_align": (aligned_cues, CUE_ALIGN),
    "cue_truncate": (cue_truncate, CUE_TRUNCATE),
    "srt_digests": (srt_digests, SRT_DIGESTS),
    "monotonic_dts": (monotonic_dts, MONOTONIC_DTS),
    "fallback_pts": (fallback_pts, FALLBACK_PTS),
    "quality_baseline": (quality_baseline, QUALITY_BASELINE),
    "circuit_breaker": (circuit_breaker, CIRCUIT_BREAKER),
    "audio_frames": (audio_frames, AUDIO_FRAMES),
    "gpu_summary": (gpu_summary, GPU_SUMMARY),
    "text_metrics": (text_metrics, TEXT_METRICS),
    "throughput": (throughput, THROUGHPUT),
    "weighted_means": (weighted_means, WEIGHTED_MEANS),
    "repeat_collapse": (repeat_collapse, REPEAT_COLLAPSE),
}
