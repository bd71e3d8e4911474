"""Language audits: assess files against requirements, find what to search for, choose releases, emit actions.

Everything that would change a service is a row of an ``actions`` frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import releases as R
from ..functions.text import cooldown_key, language_list, missing_text

COUNTERS = ("checked", "satisfied", "missing", "searched", "redownloaded", "skipped", "no_candidate", "errors")


def report(present_audio: Column, present_subtitles: Column, audio: list[str], subtitles: list[str]) -> Column:
    """struct of present and missing languages; missing ones in the order of the requirement."""
    need = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    lack = lambda of, have: F.array_except(need(of), F.coalesce(have, F.array().cast("array<string>")))
    return F.struct(present_audio.alias("present_audio"), present_subtitles.alias("present_subtitles"), lack(audio, present_audio).alias("missing_audio"), lack(subtitles, present_subtitles).alias("missing_subtitles"))


def file_report(info_audio: Column, info_subtitles: Column, languages: Column, audio: list[str], subtitles: list[str]) -> Column:
    """A report from media-info strings; audio falls back on the file's language list."""
    listed = language_list(info_audio)
    own = F.when(R.yes(F.size(listed) > 0), listed).otherwise(language_list(F.array_join(languages, ",")))
    return report(own, language_list(info_subtitles), audio, subtitles)


def satisfied(of: Column) -> Column:
    return (F.size(of["missing_audio"]) == 0) & (F.size(of["missing_subtitles"]) == 0)


def assess(files: DataFrame, audio: list[str], subtitles: list[str]) -> DataFrame:
    """Adds report, satisfied and missing (a line of text) to files (info_audio, info_subtitles, languages)."""
    judged = files.withColumn("report", file_report(F.col("info_audio"), F.col("info_subtitles"), F.col("languages"), audio, subtitles))
    return judged.withColumn("satisfied", satisfied(F.col("report"))).withColumn("missing", missing_text(F.col("report.missing_audio"), F.col("report.missing_subtitles")))


def current_files(history: DataFrame, files: DataFrame, item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Items of a history with their current file, and the number of rows without one (errors)."""
    joined = history.join(files.withColumn("_found", F.lit(True)), item, "left")
    return joined.filter("_found").drop("_found"), joined.agg(F.count_if(F.col("_found").isNull()).alias("errors"))


def latest_import(history: DataFrame, *, item: str = "item_id", day: str = "date", event: str = "event_type", wanted: str = "downloadFolderImported", depth: int = 20) -> DataFrame:
    """(item, history_id): the newest import among each item's newest ``depth`` history rows."""
    newest = Window.partitionBy(item).orderBy(F.col(day).desc_nulls_last(), F.col("id").desc())
    recent = history.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= depth).filter(F.col(event) == wanted)
    return recent.groupBy(item).agg(F.min_by("id", "_place").alias("history_id"))


def not_queued(missing: DataFrame, queue_items: DataFrame, item: str = "item_id") -> DataFrame:
    """Without the items that are in the download queue."""
    return missing.join(queue_items.select(item).distinct(), item, "left_anti")


def cooldown_days_left(checked_at: Column, now: Column, days: int) -> Column:
    """Days, rounded up, until a key may be searched again; null once it may."""
    age = now - checked_at
    window = days * 86400
    return F.when((age >= 0) & (age < window), F.ceil((window - age) / 86400).cast("int"))


def cooled(missing: DataFrame, cooldowns: DataFrame, now: Column, days: int, *, kind: str, noun: str, requirements: Column, item: str = "item_id") -> DataFrame:
    """Adds ``days_left``: a search without result, with the same requirements, is still fresh (else null).

    ``cooldowns``: key, requirements, checked_at (seconds), the newest of a key counts.
    """
    if days <= 0:
        return missing.withColumn("days_left", F.lit(None).cast("int"))
    newest = cooldowns.groupBy("key").agg(F.max_by(F.struct("requirements", "checked_at"), "checked_at").alias("_last"))
    keyed = missing.withColumn("key", cooldown_key(F.lit(kind), F.lit(noun), F.col(item)))
    same = F.col("_last.requirements") == requirements
    return keyed.join(newest, "key", "left").withColumn("days_left", F.when(same, cooldown_days_left(F.col("_last.checked_at"), now, days))).drop("_last", "key")


def newest_first(items: DataFrame, day: str = "day", item: str = "item_id") -> DataFrame:
    """Newest day first, then the larger id; items without a day last."""
    return items.orderBy(F.col(day).desc_nulls_last(), F.col(item).desc())


def within_budget(items: DataFrame, budget: int, day: str = "day", item: str = "item_id") -> DataFrame:
    """The first ``budget`` items; those in the queue or cooling down must be gone already."""
    return newest_first(items, day, item).limit(budget)


def best_release(releases: DataFrame, audio: list[str], subtitles: list[str], policy: str, *, prefer_non_torrent: bool = False, episodes: bool = True, item: str = "item_id") -> DataFrame:
    """The best acceptable release of each item; of equal ones the last in list order (``ord``).

    ``max_by`` keeps one struct a key, so it is combined before the shuffle.
    """
    release = F.struct("*")
    fits = R.can_upgrade(F.col("download_allowed"), F.col("rejected"), F.col("rejections")) & R.satisfies(release, audio, subtitles, policy)
    if episodes:
        fits = fits & R.matches_episode(release, F.col(item))
    preferred = ~R.is_torrent(F.col("protocol")) if prefer_non_torrent else F.lit(False)
    kept = releases.filter(fits).withColumn("_rank", F.struct(preferred, R.score(release), F.col("ord")))
    own = [c for c in releases.columns if c != item]
    return kept.groupBy(item).agg(F.max_by(F.struct(*own), "_rank").alias("release"))


def first_import(pending: DataFrame, items: DataFrame, fits: Column, *, download: str = "download_id") -> DataFrame:
    """For each pending download whose file does not satisfy: the first manual-import item that fits.

    ``pending``: download id, satisfied; ``items``: download id, ord and more.
    """
    wanted = pending.filter(~F.col("satisfied")).select(download)
    own = [c for c in items.columns if c != download]
    return items.filter(fits).join(wanted, download).groupBy(download).agg(F.min_by(F.struct(*own), "ord").alias("item"))


def queue_file_ids(queue: DataFrame, episodes: DataFrame, history: DataFrame, depth: int = 10) -> DataFrame:
    """The file that a queue item would replace: its own id, else its episode's, else by download history."""
    newest = Window.partitionBy("download_id").orderBy(F.col("date").desc_nulls_last(), F.col("id").desc())
    by_download = history.withColumn("_place", F.row_number().over(newest)).filter((F.col("_place") <= depth) & F.col("file_id").isNotNull()).groupBy("download_id").agg(F.min_by("file_id", "_place").alias("_by_download"))
    by_episode = episodes.select("item_id", F.col("file_id").alias("_by_episode"))
    joined = queue.join(by_episode, "item_id", "left").join(by_download, "download_id", "left")
    return joined.withColumn("file_id", F.coalesce("own_file_id", "nested_file_id", "_by_episode", "_by_download")).drop("_by_episode", "_by_download")


def redownload_actions(searched: DataFrame, *, dry_run: bool) -> DataFrame:
    """Action rows of searched items (item_id, history_id, release): grab, then mark the old import failed.

    Without a release: ``no-candidate``.  Without a history id: ``refused``, except in a dry run, which
    only says what it would do.
    """
    none = F.col("release").isNull()
    steps = F.when(none, F.array(F.lit("no-candidate")))
    if dry_run:
        steps = steps.otherwise(F.array(F.lit("would-grab")))
    else:
        steps = steps.when(F.col("history_id").isNull(), F.array(F.lit("refused"))).otherwise(F.array(F.lit("grab"), F.lit("mark-failed")))
    return searched.select("*", F.posexplode(steps).alias("step", "action"))


def summarise(outcomes: DataFrame, *group: str) -> DataFrame:
    """Sums of the counter columns; summaries of parts unite by the same sums."""
    present = [c for c in COUNTERS if c in outcomes.columns]
    return outcomes.groupBy(*group).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in present))


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    every = summaries[0]
    for s in summaries[1:]:
        every = every.unionByName(s)
    return summarise(every)


def language_audit(files: DataFrame, queue_items: DataFrame, cooldowns: DataFrame, releases: DataFrame | Callable[[DataFrame], DataFrame], history: DataFrame, *, audio: list[str], subtitles: list[str], policy: str, now: Column, cooldown_days: int, budget: int, kind: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(actions, summary) of one audit: cheap filters before the release search, in this order: queue,
    cooldown, budget, history id.  ``releases`` may be a search: it is given the items (item_id) to search for
    and returns their releases, so that those of other items are not even read into fields."""
    judged = assess(files, audio, subtitles)
    missing = judged.filter(~F.col("satisfied"))
    requirements = F.lit(f"{audio}|{subtitles}")
    waiting = cooled(not_queued(missing, queue_items), cooldowns, now, cooldown_days, kind=kind, noun="item", requirements=requirements)
    eligible = within_budget(waiting.filter(F.col("days_left").isNull()), budget)
    found = releases if isinstance(releases, DataFrame) else releases(F.broadcast(eligible.select("item_id")))  # at most ``budget`` rows
    chosen = best_release(found, audio, subtitles, policy, episodes=kind == "tv")
    searched = eligible.select("item_id").join(chosen, "item_id", "left").join(latest_import(history), "item_id", "left")
    actions = redownload_actions(searched, dry_run=dry_run)
    counts = judged.agg(F.count("*").alias("checked"), F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("missing"))
    searches = searched.agg(F.count("*").alias("searched"), F.count_if(F.col("release").isNull()).alias("no_candidate"))
    return actions, counts.join(searches, F.lit(True))
