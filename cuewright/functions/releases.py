"""Expressions over release candidates and queue items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

#: How much a release's names may stand in for its language metadata, least first.
POLICIES = ("strict", "custom-format", "custom-format-or-title", "title-guess")

#: Rejections that an upgrade may have.
UPGRADE_REJECTIONS = (
    "existing file",
    "meets cutoff",
    "quality profile does not allow upgrades",
    "equal or higher custom format score",
    "equal or higher preference",
)
#: Warnings of a download that does not hold what was asked for.
MISMATCHES = (
    "one or more episodes expected",
    "was not found in the grabbed release",
    "episode wasn't requested",
    "wrong episode",
    "wrong season",
    "full season pack",
)
#: What a title says of a language when guessing.
TITLE_GUESSES = {"eng": ("eng", "dub"), "jpn": ("jpn", "jap", "japanese"), "spa": ("spa", "spanish"), "fra": ("fre", "fra", "french")}

STALE = "stale zero-size torrent queue item"
INVALID = "invalid season or episode"
MISMATCH = "episode mismatch or multi-episode pack"


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def day_number(iso: Column) -> Column:
    """Days since 1970 of the first ten characters; null if they are no date."""
    return F.unix_date(F.left(iso, F.lit(10)).try_cast("date"))


def is_torrent(protocol: Column) -> Column:
    """``torrent`` in any case, or the number 2."""
    return yes(ascii_lower(protocol).isin("torrent", "2"))


def is_stale(added: Column, today: Column, stale_days: int) -> Column:
    return yes(today - day_number(added) >= stale_days) if stale_days > 0 else F.lit(False)


def zero_size(size: Column, left: Column) -> Column:
    return (F.coalesce(size, F.lit(0)) == 0) & (F.coalesce(left, F.lit(0)) == 0)


def status_text(error: Column, messages: Column) -> Column:
    """The error and all nested titles and messages in lower case, a line each."""
    nested = F.flatten(F.transform(messages, lambda m: F.concat(F.array(m["title"]), F.coalesce(m["messages"], F.array().cast("array<string>")))))
    return ascii_lower(F.array_join(F.array_compact(F.concat(F.array(error), F.coalesce(nested, F.array().cast("array<string>")))), "\n"))


def bad_queue_reason(status: Column, state: Column, tracked: Column, protocol: Column, size: Column, left: Column, added: Column, text: Column, today: Column, stale_days: int) -> Column:
    """Why a queue item should go; null if it should not. The first reason that applies."""
    stuck = (status == "queued") & (state == "downloading") & (tracked == "ok") & (protocol == "torrent") & zero_size(size, left) & is_stale(added, today, stale_days)
    warned = (status == "completed") & (tracked == "warning")
    return F.when(yes(stuck), STALE).when(~yes(warned), F.lit(None)).when(yes(F.contains(text, F.lit(INVALID))), INVALID).when(yes(any_of(text, MISMATCHES)), MISMATCH)


def reason_priority(reason: Column) -> Column:
    return F.when(reason.isin(INVALID, MISMATCH), 0).when(reason == STALE, 10).otherwise(20)


def numeric_range(title: Column) -> Column:
    """A ``-`` between runs of one to three digits (a date counts through its month and day)."""
    return yes(title.rlike(r"(?<![0-9])[0-9]{1,3}-[0-9]{1,3}(?![0-9])"))


def is_pack(release_type: Column) -> Column:
    return yes(any_of(ascii_lower(release_type), ("pack", "multi", "season")))


def matches_episode(release: Column, episode: Column) -> Column:
    """Whether a release struct is for this one episode; the first field that says something decides."""
    one = lambda ids: (F.size(ids) == 1) & yes(F.try_element_at(ids, F.lit(1)) == episode)
    mapped, ids = release["mapped_ids"], release["episode_ids"]
    return (
        F.when(is_pack(release["release_type"]), False)
        .when(yes(F.size(mapped) > 0), one(mapped))
        .when(ids.isNotNull(), one(ids))
        .when(release["episode_id"].isNotNull(), release["episode_id"] == episode)
        .when(yes(F.size(release["episode_numbers"]) > 1) | yes(F.size(release["absolute_numbers"]) > 1), False)
        .otherwise(~numeric_range(release["title"]))
    )


def matches_item(episodes: Column, ids: Column, single: Column, episode: Column) -> Column:
    """The same for a manual-import item."""
    one = lambda x: (F.size(x) == 1) & yes(F.try_element_at(x, F.lit(1)) == episode)
    return F.when(episodes.isNotNull(), one(episodes)).when(ids.isNotNull(), one(ids)).otherwise(yes(single == episode))


def can_upgrade(allowed: Column, rejected: Column, rejections: Column) -> Column:
    only_known = (F.size(rejections) > 0) & F.forall(rejections, lambda r: any_of(ascii_lower(F.coalesce(r, F.lit(""))), UPGRADE_REJECTIONS))
    return F.when(yes(~allowed), False).when(~yes(rejected), True).otherwise(yes(only_known))


def title_words(title: Column) -> Column:
    return F.translate(ascii_lower(F.coalesce(title, F.lit(""))), "._-", "   ")


def formats_hint_audio(formats: Column, audio: list[str]) -> Column:
    has = lambda test: yes(F.exists(formats, lambda f: test(ascii_lower(f))))
    many = has(lambda f: F.contains(f, F.lit("multi")) & any_of(f, ("audio", "dub")))
    return many | has(lambda f: any_of(f, ("dub", "eng"))) if "eng" in audio else many


def formats_hint_subtitles(formats: Column) -> Column:
    return yes(F.exists(formats, lambda f: F.contains(ascii_lower(f), F.lit("sub"))))


def title_hints_audio(title: Column, audio: list[str], loose: bool) -> Column:
    words = title_words(title)
    out = any_of(words, ("dual audio", "multi audio", "multi dub"))
    if "eng" in audio:
        out = out | any_of(words, ("english dub", "eng dub"))
    for lang in audio if loose else ():
        out = out | any_of(words, TITLE_GUESSES.get(lang, (lang,)))
    return out


def title_hints_subtitles(title: Column, loose: bool) -> Column:
    words = title_words(title)
    return any_of(words, ("multi sub", "msubs", *(("sub",) if loose else ())))


def audio_hint(title: Column, formats: Column, audio: list[str], policy: str) -> Column:
    if policy == "strict":
        return F.lit(True)
    out = formats_hint_audio(formats, audio)
    return out if policy == "custom-format" else out | title_hints_audio(title, audio, policy == "title-guess")


def audio_satisfied(title: Column, languages: Column, formats: Column, audio: list[str], policy: str) -> Column:
    """Of a sole English requirement the looser policies also want a hint, even if the metadata has it."""
    if not audio:
        return F.lit(True)
    listed = yes(F.size(F.array_except(F.array(*map(F.lit, audio)), languages)) == 0)
    hint = audio_hint(title, formats, audio, policy)
    if policy == "strict":
        return listed
    return F.when(listed, hint if audio == ["eng"] else F.lit(True)).otherwise(hint)


def subtitles_satisfied(title: Column, languages: Column, formats: Column, subtitles: list[str], policy: str) -> Column:
    if not subtitles:
        return F.lit(True)
    listed = yes((F.size(languages) > 0) & (F.size(F.array_except(F.array(*map(F.lit, subtitles)), languages)) == 0))
    if policy == "strict":
        return listed
    hint = formats_hint_subtitles(formats)
    return listed | (hint if policy == "custom-format" else hint | title_hints_subtitles(title, policy == "title-guess"))


def satisfies(release: Column, audio: list[str], subtitles: list[str], policy: str) -> Column:
    """Whether a release struct meets the language requirements under a policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    return audio_satisfied(release["title"], release["languages"], release["custom_formats"], audio, policy) & subtitles_satisfied(release["title"], release["subtitle_languages"], release["custom_formats"], subtitles, policy)


def evidence(release: Column, audio: list[str], policy: str) -> Column:
    """What speaks for a release's languages, in one line."""
    listed = lambda name, of: F.when(F.size(of) > 0, F.concat(F.lit(f"{name} ["), F.array_join(of, ", "), F.lit("]")))
    lower = F.transform(release["custom_formats"], ascii_lower)
    parts = [listed("release languages", F.array_sort(release["languages"])), listed("subtitle languages", F.array_sort(release["subtitle_languages"])), listed("custom formats", lower)]
    if policy != "strict":
        loose = policy == "title-guess"
        parts += [
            F.when(formats_hint_audio(release["custom_formats"], audio), "custom-format audio hint"),
            F.when(formats_hint_subtitles(release["custom_formats"]), "custom-format subtitle hint"),
            F.when(title_hints_audio(release["title"], audio, loose), "title audio hint"),
            F.when(title_hints_subtitles(release["title"], loose), "title subtitle hint"),
        ]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "no language evidence").otherwise(joined)


def unknown_movie(rejections: Column) -> Column:
    return yes(F.exists(rejections, lambda r: ascii_lower(r) == "unknown movie"))


def score(release: Column) -> Column:
    """Custom-format score plus quality weight, each 0 if missing."""
    return F.coalesce(release["custom_format_score"], F.lit(0)) + F.coalesce(release["quality_weight"], F.lit(0))
