"""Repairs of recognised text over whole documents, with faults made by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import repair
from ..functions import text as T
from .stand_ins import table


def spaced_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose spaces after marks, between letters and digits and before quotes were lost, spaced again."""
    lost = F.regexp_replace(F.regexp_replace("text", "([,.;:!?]) ", "$1"), "([A-Za-z0-9]) ([0-9\"A-Z])", "$1$2")
    fixed = T.space_before_quote(T.space_letters_digits(T.space_after_punctuation(lost)))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(fixed, "UTF-8")).alias("digest"), (F.length(fixed) - F.length(lost)).alias("spaces"))


SPACED_DOCUMENTS = r"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([,.;:!?]) ', '\1', 'g'), '([A-Za-z0-9]) ([0-9"A-Z])', '\1\2', 'g') AS t FROM documents),
p AS (SELECT *, regexp_replace(regexp_replace(t, '([,.;:!?])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g') AS a FROM l),
o AS (SELECT *, replace(regexp_replace(regexp_replace(a, '([0-9])((?i:st|nd|rd|th))([^A-Za-z]|$)', '\1' || chr(1) || '\2\3', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), chr(1), '') AS b FROM p),
q AS (SELECT *, regexp_replace(regexp_replace(b, '([A-Za-z])("[A-Za-z])', '\1 \2', 'g'), '([A-Za-z])("[A-Za-z])', '\1 \2', 'g') AS c FROM o)
SELECT doc_id, md5(c) AS digest, (length(c) - length(t))::INT AS spaces FROM q"""


def dialogue_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as styled dialogue lines: their text, their styles without fonts, and the text escaped."""
    lines = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    styled = F.expr(r"concat('Dialogue: 0,0:00:0', cast(line % 10 as string), '.00,', case line % 4 when 0 then '{\\fs20\\an8}' when 1 then '{\\fnArial Bold\\b1}' when 2 then '{open' else '' end, said, '\\N{\\fscx90.5}}')")
    return lines.select("doc_id", "line", F.md5(F.encode(T.ass_text(styled), "UTF-8")).alias("text"), F.md5(F.encode(T.strip_font_overrides(styled), "UTF-8")).alias("styles"), F.md5(F.encode(T.ass_escape(styled), "UTF-8")).alias("escaped"))


DIALOGUE_TEXTS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line, 'Dialogue: 0,0:00:0' || line % 10 || '.00,' || CASE line % 4 WHEN 0 THEN '{\fs20\an8}' WHEN 1 THEN '{\fnArial Bold\b1}' WHEN 2 THEN '{open' ELSE '' END || said || '\N{\fscx90.5}}' AS t FROM l),
p AS (SELECT *, replace(replace(regexp_replace(regexp_replace(t, '(?s)^.*,', ''), '(?s)\{[^}]*(\}|$)', '', 'g'), '}', ''), '\N', chr(10)) AS own FROM s)
SELECT doc_id, line, md5(array_to_string(list_filter(list_transform(string_split(replace(own, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS text,
  md5(regexp_replace(regexp_replace(t, '\\fsc[xy][0-9.+-]*|\\fs[0-9.+-]+', '', 'gi'), '\\fn[^\\{}]*', '', 'gi')) AS styles, md5(replace(replace(replace(replace(replace(t, chr(13), ''), '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\N')) AS escaped FROM p"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """(w, n): all words of small letters of the documents."""
    every = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9'|])[a-z]{4,}(?![A-Za-z0-9'|])"), F.lit(0))).alias("w"))
    return every.groupBy("w").agg(F.count("*").alias("n"))


#: Letters that a recogniser takes for others, as the repair undoes them.
FAULTS = (("w", "vv"), ("o", "0"), ("l", "1"), ("s", "5"), ("b", "8"))


def confused_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with one letter read as another sign throughout, for each such sign: what the repair makes of them."""
    words = _words(spark, sf).filter("w not like '%vv%'").select("w", F.explode(F.array(*(F.struct(F.lit(a).alias("was"), F.lit(b).alias("sign")) for a, b in FAULTS))).alias("f")).select("w", "f.*")
    faulty = words.filter(F.contains("w", F.col("was")) & (F.replace("w", F.col("was"), F.lit("")) != "")).withColumn("read", F.replace("w", F.col("was"), F.col("sign")))
    return faulty.select("read", repair.unconfused_text(F.col("read")).alias("now"))


CONFUSED_WORDS = """WITH w AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9''|]+')), '^$', '') AS w FROM documents), f(was, sign) AS (VALUES ('w', 'vv'), ('o', '0'), ('l', '1'), ('s', '5'), ('b', '8'))
SELECT replace(w, was, sign) AS read, w AS now FROM w, f WHERE regexp_full_match(w, '[a-z]{4,}') AND NOT contains(w, 'vv') AND contains(w, was) AND replace(w, was, '') <> ''"""


def _each(words: Column, change) -> Column:
    """A repair of single words as an Arrow function; equal results in any batch."""

    @F.pandas_udf(StringType())
    def changed(own):  # a word a row, all different
        return own.map(change)

    return changed(words)


def corrected_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with letters read as others, corrected by the words that the documents hold three times or more."""
    shared = spark.sparkContext.broadcast(repair.learn(table(spark, sf, "documents")))
    faults = F.array(*(F.struct(F.lit(a).alias("was"), F.lit(b).alias("sign")) for a, b in (("y", "v"), ("t", "f"), ("n", "hq"), ("th", "fh"), ("ook", "cok"), ("c", "oc"), ("to", "lo"))))
    words = _words(spark, sf).select("w", F.explode(faults).alias("f")).filter(F.contains("w", F.col("f.was"))).select(F.replace("w", F.col("f.was"), F.col("f.sign")).alias("read")).distinct()
    return words.select("read", _each(F.col("read"), lambda w: repair.corrected(w, shared.value)).alias("now"))


_LEXICON_SQL = r"""lw AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents),
lexicon AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rank FROM lw WHERE regexp_matches(w, '[a-z]') GROUP BY w HAVING count(*) >= 3) WHERE rank <= 50000)"""

CORRECTED_WORDS = rf"""WITH {_LEXICON_SQL}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9''|]+')) AS w FROM documents), f(was, sign) AS (VALUES ('y', 'v'), ('t', 'f'), ('n', 'hq'), ('th', 'fh'), ('ook', 'cok'), ('c', 'oc'), ('to', 'lo')),
r AS (SELECT DISTINCT replace(w, was, sign) AS r FROM w, f WHERE regexp_full_match(w, '[a-z]{{4,}}') AND contains(w, was)),
c AS (SELECT r, unnest([replace(r, 'v', 'y'), replace(r, 'f', 't'), replace(r, 'hq', 'n'), replace(r, 'fh', 'th'), replace(r, 'cok', 'ook'), CASE WHEN suffix(r, 'f') THEN r[1:length(r) - 1] || 'th' ELSE r END, CASE WHEN suffix(r, 'l') THEN r[1:length(r) - 1] || '''ll' ELSE r END, replace(r, 'oc', 'c'), replace(r, 'lo', 'to')]) AS x, unnest(range(9)) AS place FROM r),
b AS (SELECT r, arg_min(x, place) AS x FROM c WHERE x <> r AND x IN (SELECT w FROM lexicon) GROUP BY r)
SELECT r.r AS read, CASE WHEN r.r IN (SELECT w FROM lexicon) THEN r.r WHEN r.r = 'exhusband' THEN 'ex-husband' ELSE coalesce(b.x, r.r) END AS now FROM r LEFT JOIN b ON b.r = r.r"""


def known_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Every two words of all texts glued together, cut into words that the same texts hold three times or more."""
    docs = table(spark, sf, "documents")
    shared = spark.sparkContext.broadcast(repair.learn(docs))
    tokens = repair.glued(docs, "[a-z]+").groupBy("token").agg(F.count("*").alias("n"))

    def cut(word: str) -> str | None:
        pieces = repair.split_known(word, shared.value)
        return pieces and " ".join(pieces)

    return tokens.withColumn("cut", _each(F.col("token"), cut))


KNOWN_CUTS = rf"""WITH RECURSIVE {_LEXICON_SQL}, d AS (SELECT regexp_extract_all(text, '[a-z]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest([ws[k] || coalesce(ws[k + 1], '') for k in range(1, len(ws) + 1, 2)]) AS token FROM d) GROUP BY token),
g AS MATERIALIZED (SELECT w, 10 * length(w) - 8 - CASE WHEN length(w) <= 2 THEN 6 ELSE 0 END + CASE WHEN length(w) >= 4 THEN 6 ELSE 0 END AS gain FROM lexicon WHERE length(w) BETWEEN 2 AND 16 OR w IN ('i', 'a')),
r(token, i, scores, counts, cuts) AS (SELECT token, 0, [0]::BIGINT[], [0]::BIGINT[], [0]::BIGINT[] FROM t WHERE length(token) >= 4 AND token NOT IN (SELECT w FROM lexicon)
  UNION ALL SELECT token, i + 1, list_append(scores, best.s), list_append(counts, -best.p), list_append(cuts, best.k) FROM (
    SELECT token, i, scores, counts, cuts, max(CASE WHEN scores[i + 2 - k] + gain IS NOT NULL THEN struct_pack(s := scores[i + 2 - k] + gain, p := -counts[i + 2 - k] - 1, k := k) END) AS best
    FROM (SELECT *, unnest(range(1, least(i + 1, 16) + 1)) AS k FROM r WHERE i < length(token)) LEFT JOIN g ON g.w = token[i + 2 - k:i + 1] GROUP BY token, i, scores, counts, cuts)),
p(token, cuts, pos, parts) AS (SELECT token, cuts, i, []::VARCHAR[] FROM r WHERE i = length(token) AND scores[i + 1] IS NOT NULL AND counts[i + 1] >= 2
  UNION ALL SELECT token, cuts, pos - cuts[pos + 1], list_prepend(token[pos - cuts[pos + 1] + 1:pos], parts) FROM p WHERE pos > 0)
SELECT t.token, n, array_to_string(parts, ' ') AS cut FROM t LEFT JOIN (SELECT token, parts FROM p WHERE pos = 0) s ON s.token = t.token"""


QUERIES = {
    "spaced_documents": (spaced_documents, SPACED_DOCUMENTS),
    "dialogue_texts": (dialogue_texts, DIALOGUE_TEXTS),
    "confused_words": (confused_words, CONFUSED_WORDS),
    "corrected_words": (corrected_words, CORRECTED_WORDS),
    "known_cuts": (known_cuts, KNOWN_CUTS),
}
