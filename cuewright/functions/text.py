"""String expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as in trimming and splitting on it; the first part lets ASCII letters fail at once.
WS = r"[\x00- \x7F-\x{10FFFF}&&[\s\u0085   -     　]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spellings of a language and its three-letter tag; any other tag stands for itself.
LANGUAGE_TAGS = {
    "eng": ["en", "eng", "english"],
    "fra": ["fr", "fre", "fra", "french"],
    "spa": ["es", "spa", "spanish"],
    "deu": ["de", "ger", "deu", "german"],
    "ita": ["it", "ita", "italian"],
    "por": ["pt", "por", "portuguese"],
    "jpn": ["ja", "jpn", "japanese"],
    "kor": ["ko", "kor", "korean"],
    "zho": ["zh", "zho", "chi", "chinese"],
    "rus": ["ru", "rus", "russian"],
    "nld": ["nl"],
    "pol": ["pl"],
    "swe": ["sv"],
    "nor": ["no", "nb"],
    "dan": ["da"],
    "fin": ["fi"],
    "ces": ["cs", "cz", "cze"],
    "ell": ["el", "gre"],
    "heb": ["he"],
    "hin": ["hi"],
    "ara": ["ar"],
    "tur": ["tr"],
    "tha": ["th"],
    "vie": ["vi"],
    "ind": ["id"],
    "ukr": ["uk"],
}

#: Spellings that a recogniser's model answers to; any other tag stands for itself.
RECOGNISER_TAGS = {
    "eng": ["en", "eng"],
    "spa": ["es", "spa"],
    "fra": ["fr", "fra", "fre"],
    "deu": ["de", "deu", "ger"],
    "ita": ["it", "ita"],
    "por": ["pt", "por"],
    "nld": ["nl", "nld", "dut"],
    "swe": ["sv", "swe"],
    "nor": ["no", "nor"],
    "dan": ["da", "dan"],
    "fin": ["fi", "fin"],
    "pol": ["pl", "pol"],
    "ces": ["cs", "ces", "cze"],
    "hun": ["hu", "hun"],
    "ron": ["ro", "ron", "rum"],
    "tur": ["tr", "tur"],
    "ell": ["el", "ell", "gre"],
    "rus": ["ru", "rus"],
    "ukr": ["uk", "ukr"],
    "ara": ["ar", "ara"],
    "heb": ["he", "heb"],
    "hin": ["hi", "hin"],
    "tha": ["th", "tha"],
    "vie": ["vi", "vie"],
    "ind": ["id", "ind"],
    "jpn": ["ja", "jpn"],
    "kor": ["ko", "kor"],
    "chi_sim": ["zh", "zho", "chi"],
}


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """``table[key]`` as one map literal; ``default`` (null if none) for other keys."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spellings(table: dict[str, list[str]]) -> dict[str, str]:
    return {word: tag for tag, words in table.items() for word in words}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    """Trims Unicode white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(text, f"^{WS}++|{WS}(?<!{WS}{WS}){WS}*+$", "")


def normalise_lines(text: Column) -> Column:
    """Lines trimmed, empty ones and carriage returns gone, joined by line feeds.

    White space after a line feed goes, then blanks before one; a match begins where the blanks do, so
    that a long blank run is read once.
    """
    blank = r"[ \t\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
    left = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), rf"\n{WS}*+", "\n")
    joined = F.regexp_replace(left, rf"{blank}(?<!{blank}{blank}){blank}*+(?=\n)", "")
    return strip(joined)


def language_tag(tag: Column) -> Column:
    """The language of a tag such as ``en-US``; null for empty, ``und`` and ``unknown``."""
    known = spellings(LANGUAGE_TAGS)
    tagged = lambda primary: F.when(~primary.isin("", "und", "unknown"), lookup(primary, known, primary))
    return F.coalesce(lookup(tag, known | {word.title(): of for word, of in known.items()}), let(F.split(ascii_lower(strip(tag)), "[-_]")[0], tagged))


def recogniser_language(tag: Column) -> Column:
    """The recogniser's model name for a tag; null for an empty one."""
    whole = ascii_lower(strip(tag))
    primary = strip(F.split(whole, "[-_]")[0])
    return F.when(whole != "", lookup(primary, spellings(RECOGNISER_TAGS), primary))


def script_subtag(tag: Column) -> Column:
    """The first part of four letters, in lower case; null if there is none."""
    return ascii_lower(F.try_element_at(F.filter(F.split(tag, "[-_]"), lambda p: p.rlike("^[A-Za-z]{4}$")), F.lit(1)))


def language_list(raw: Column) -> Column:
    """Languages of a delimited list: normalised, distinct and sorted."""
    tags = F.transform(F.split(raw, r"[,/;|\s]+"), language_tag)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull())))


def file_name_part(text: Column) -> Column:
    """Illegal and control characters as ``-``, dots and spaces trimmed, ``unknown`` if nothing is left."""
    clean = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F\x7F-\x{9F}]', "-")
    clean = strip(F.regexp_replace(strip(clean), r"^\.+|\.+$", ""))
    return F.when(clean == "", F.lit("unknown")).otherwise(clean)


def sidecar_language(tag: Column) -> Column:
    """Lower case, only [a-z0-9-_] kept; ``und`` if nothing is left."""
    clean = F.regexp_replace(ascii_lower(tag), "[^a-z0-9_-]", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("und")).otherwise(clean)


def percent_encode(text: Column) -> Column:
    """Every byte but letters, digits and ``-_.~`` as %XX."""
    form = F.url_encode(text)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(was), F.lit(now))
    return form


#: Heights that a file name can carry.
KNOWN_HEIGHTS = (360, 480, 720, 1080, 1440, 2160)


def quality_label(stem: Column, height: Column) -> Column:
    """The last stand-alone ``<height>p`` of a stem rewritten to a target height, unless that is larger."""
    label = r"(?is)^(.*(?<![A-Za-z0-9]))(" + "|".join(map(str, KNOWN_HEIGHTS)) + r")p(?![A-Za-z0-9])(.*)$"
    part = lambda k: F.regexp_extract(stem, label, k)
    renamed = F.concat(part(1), height.cast("string"), F.lit("p"), part(3))
    return F.when((part(2) != "") & (height <= part(2).try_cast("int")), renamed).otherwise(stem)


def strip_font_tags(html: Column) -> Column:
    """Without font tags; other tags stay, as does a tag that is not closed."""
    return F.regexp_replace(html, r"(?i)<\s*/?font([ \t][^>]*)?>", "")


def strip_font_overrides(ass: Column) -> Column:
    r"""Without ``\fs``, ``\fscx``, ``\fscy`` and ``\fn`` with their values."""
    sizes = F.regexp_replace(ass, r"(?i)\\fsc[xy][0-9.+-]*|\\fs[0-9.+-]+", "")
    return F.regexp_replace(sizes, r"(?i)\\fn[^\\{}]*", "")


def strip_styles(text: Column) -> Column:
    """Without font tags, font overrides and the override blocks that they leave empty."""
    return F.replace(strip_font_overrides(strip_font_tags(text)), F.lit("{}"), F.lit(""))


def plain_text_packet(packet: Column) -> Column:
    """A text packet (two bytes of length, text, style boxes) without styles: its text stripped, its boxes gone.

    Packets that are too short for their length, or whose text would be too long for it, stay as they are.
    Bytes that are no UTF-8 count as U+FFFD.
    """
    said = F.conv(F.hex(F.substring(packet, 1, 2)), 16, 10).cast("int")
    raw = F.substring(packet, F.lit(3), said)
    text = strip_styles(F.make_valid_utf8(raw.cast("string"))).cast("binary")
    whole = (F.octet_length(packet) >= 2) & (said + 2 <= F.octet_length(packet)) & (F.octet_length(text) <= 65535)
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 4, "0"))
    return F.when(whole & ((said + 2 < F.octet_length(packet)) | (text != raw)), F.concat(size, text)).otherwise(packet)


def ass_text(line: Column) -> Column:
    r"""The text of a dialogue line: after its last comma, without ``{...}``, ``\N`` as line feeds."""
    text = F.regexp_replace(line, r"(?s)^.*,", "")
    text = F.replace(F.regexp_replace(text, r"(?s)\{[^}]*(\}|$)", ""), F.lit("}"), F.lit(""))
    return normalise_lines(F.replace(text, F.lit("\\N"), F.lit("\n")))


def ass_escape(text: Column) -> Column:
    r"""Carriage returns gone; backslash, braces and line feeds escaped, in this order."""
    text = F.replace(text, F.lit("\r"), F.lit(""))
    for was, now in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(was), F.lit(now))
    return text


def ass_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("&H%02X%02X%02X&", b.cast("int"), g.cast("int"), r.cast("int"))


def rgb_of_ass(colour: Column) -> Column:
    """struct(r, g, b) of ``&HBBGGRR&``; null if it is none."""
    digits = F.regexp_extract(colour, r"^&?[Hh]?([0-9A-Fa-f]{6})&?$", 1)
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(5).alias("r"), part(3).alias("g"), part(1).alias("b")))


def space_after_punctuation(text: Column) -> Column:
    """A space between ``, . ; : ! ?`` and the letter that follows it."""
    return F.regexp_replace(text, r"(?<=[,.;:!?])(?=[A-Za-z])", " ")


def space_letters_digits(text: Column) -> Column:
    """A space where letters and digits meet, but not within ordinals such as 21st."""
    split = F.regexp_replace(text, r"(?<=[A-Za-z])(?=[0-9])", " ")
    return F.regexp_replace(split, r"(?<=[0-9])(?!(?i:st|nd|rd|th)(?![A-Za-z]))(?=[A-Za-z])", " ")


def space_before_quote(text: Column) -> Column:
    """A space between a letter and the quotation mark that opens the next word."""
    return F.regexp_replace(text, r'(?<=[A-Za-z])(?="[A-Za-z])', " ")


def evaluation_text(text: Column) -> Column:
    """Smart quotes and ellipses plain, white space collapsed, trimmed."""
    plain = text
    for was, now in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("…", "...")):  # faster than a translation of every character
        plain = F.replace(plain, F.lit(was), F.lit(now))
    return F.regexp_replace(F.regexp_replace(plain, f"{WS}+", " "), "^ | $", "")


def collapsed_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), "^ | $", ""))


def stripped_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, f"{WS}+", ""))


def word_tokens(text: Column) -> Column:
    """Lower-case words (with apostrophes) and single marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w']+|[^\w\s])"), F.lit(1))


def bits_per_second(raw: Column) -> Column:
    """A bit rate such as ``1.5M`` or ``320 kbps`` in bits a second; null if it is none."""
    lower = F.replace(ascii_lower(strip(raw)), F.lit(" "), F.lit(""))
    form = r"^([0-9.,_]+)(|b|kbit|kb|k|mbit|mb|m|gbit|gb|g)(?:|/s|ps|bps|bits|bit)$"
    number = F.regexp_replace(F.regexp_extract(lower, form, 1), "[,_]", "")
    factor = lookup(F.substring(F.regexp_extract(lower, form, 2), 1, 1), {"": 1.0, "b": 1.0, "k": 1e3, "m": 1e6, "g": 1e9})
    value = F.round(number.try_cast("double") * factor).cast("long")
    return F.when(lower.rlike(form) & (value > 0), value)


def boolish(raw: Column) -> Column:
    """True for true/1/yes/y, false for false/0/no/n, null otherwise."""
    word = ascii_lower(raw)
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)


def joined_path(root: Column, relative: Column) -> Column:
    return F.when(relative.startswith("/"), relative).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), relative))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def pairs(raw: Column) -> Column:
    """``k=v,k=v`` as a map; parts without a key or value are dropped; of equal keys the first holds."""
    entry = lambda q: F.when(F.size(q) == 2, F.struct(ascii_lower(strip(q[0])).alias("key"), strip(F.try_element_at(q, F.lit(2))).alias("value")))
    entries = F.transform(F.split(raw, ","), lambda p: let(F.split(p, "=", 2), entry))
    good = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    first = lambda own, keys: F.map_from_entries(F.filter(own, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
    return let(good, lambda own: let(F.transform(own, lambda e: e["key"]), lambda keys: first(own, keys)))


def missing_text(audio: Column, subtitles: Column) -> Column:
    """``audio [..]; subtitles [..]`` of what is missing; empty lists are left out."""
    part = lambda name, of: F.when(F.size(of) > 0, F.concat(F.lit(f"{name} ["), F.array_join(of, ", "), F.lit("]")))
    return F.concat_ws("; ", part("audio", audio), part("subtitles", subtitles))


def described_bitrate(bps: Column) -> Column:
    return F.coalesce(F.concat(bps.cast("string"), F.lit(" bps")), F.lit("match source"))


def described_size(width: Column, height: Column) -> Column:
    return F.coalesce(F.concat(F.lit("max "), width.cast("string"), F.lit("x"), height.cast("string")), F.lit("match source"))


#: How codecs are written out.
CODEC_NAMES = {"h264": "H.264", "aac": "AAC", "hevc": "HEVC", "vp9": "VP9"}


def described_codec(codec: Column) -> Column:
    return lookup(codec, CODEC_NAMES, F.coalesce(codec, F.lit("unknown")))


def with_suffix(path: Column, suffix: Column) -> Column:
    """The suffix (given a dot in front, null or blank: none) put before the extension."""
    clean = strip(suffix)
    dotted = F.when(F.coalesce(clean, F.lit("")) == "", F.lit("")).when(clean.startswith("."), clean).otherwise(F.concat(F.lit("."), clean))
    extension = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), dotted, extension)


def cooldown_key(kind: Column, noun: Column, item: Column) -> Column:
    return F.concat_ws(":", kind, noun, item.cast("string"))


def system_language(*candidates: Column) -> Column:
    """The first non-empty of some settings, cut at ``.`` and ``@``."""
    first = F.coalesce(*(F.when(strip(c) != "", strip(c)) for c in candidates))
    return F.nullif(F.split_part(F.split_part(first, F.lit("."), F.lit(1)), F.lit("@"), F.lit(1)), F.lit(""))


def redacted(key: Column, value: Column) -> Column:
    """The value, or ``***`` where the key names a secret."""
    return F.when(ascii_lower(key).rlike("token|password|secret|api_key|apikey"), F.lit("***")).otherwise(value)


def env_ids(*candidates: Column) -> Column:
    """Integers of the first setting that has any, split at ``| , ;`` and spaces."""
    parse = lambda c: F.filter(F.transform(F.split(c, r"[|,;\s]+"), lambda p: p.try_cast("long")), lambda v: v.isNotNull())
    empty = F.array().cast("array<bigint>")
    return F.coalesce(*(let(parse(c), lambda ids: F.when(F.size(ids) > 0, ids)) for c in candidates), empty)


def device_ids(raw: Column) -> Column:
    """Integers of a comma list: invalid ones dropped, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda p: strip(p).try_cast("int")), lambda v: v.isNotNull() & (v >= 0))))


def fnv1a(text: Column) -> Column:
    """FNV-1a (64 bits) of the UTF-8 bytes, as 16 hex digits.

    The product by the prime 2**40 + 435 is taken in 32-bit halves, as a long times a long must not
    overflow.
    """
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(state: Column, byte: Column) -> Column:
        low = state["low"].bitwiseXOR(byte)
        product = low * 435
        high = (state["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(low32)
        return F.struct(high.alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    end = F.aggregate(F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")), start, step)
    return F.lower(F.concat(F.lpad(F.hex(end["high"]), 8, "0"), F.lpad(F.hex(end["low"]), 8, "0")))
