"""Download-queue health: conditional counts, reasons and removal order.

Queue frames have the columns id, kind, status, state, tracked, protocol, size, left, added, error and
messages (``sources.landing.queue_items``); ``today`` is a day number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import releases as R


def with_reasons(queue: DataFrame, today: Column, stale_days: int) -> DataFrame:
    """Adds ``reason``: why the item should go; null if it should not."""
    text = R.status_text(F.col("error"), F.col("messages"))
    return queue.withColumn("reason", R.bad_queue_reason(F.col("status"), F.col("state"), F.col("tracked"), F.col("protocol"), F.col("size"), F.col("left"), F.col("added"), text, today, stale_days))


def health_counts(stale: Column) -> list[Column]:
    """Ten counts in one pass; a row may count several times."""
    status, state, tracked = F.col("status"), F.col("state"), F.col("tracked")
    torrent = R.yes(F.col("protocol") == "torrent")
    zero = R.zero_size(F.col("size"), F.col("left"))
    moving = lambda s, empty: torrent & (status == s) & (state == "downloading") & (zero if empty else ~zero)
    return [
        F.count("*").alias("total"),
        F.count_if((status == "completed") & (state == "importPending")).alias("completed_import_pending"),
        F.count_if((status == "completed") & (state == "importBlocked")).alias("completed_import_blocked"),
        F.count_if((status == "completed") & (tracked == "warning")).alias("completed_warning"),
        F.count_if(torrent & zero & stale).alias("stale_zero_size_torrents"),
        F.count_if(moving("queued", True)).alias("queued_zero_size_torrents"),
        F.count_if(moving("queued", False)).alias("queued_nonzero_torrents"),
        F.count_if(moving("downloading", True)).alias("downloading_zero_size_torrents"),
        F.count_if(moving("downloading", False)).alias("downloading_nonzero_torrents"),
        F.count_if(F.col("reason").isin(R.INVALID, R.MISMATCH)).alias("invalid_or_mismatch_warnings"),
    ]


def health(queue: DataFrame, today: Column, stale_days: int, *group: str) -> DataFrame:
    return with_reasons(queue, today, stale_days).groupBy(*group).agg(*health_counts(R.is_stale(F.col("added"), today, stale_days)))


def removals(queue: DataFrame, today: Column, stale_days: int, cap: int = 0, *, partition: str | None = None) -> DataFrame:
    """Items to remove, in order: mismatches, then stale ones, oldest first; ``cap`` stale ones at most (0: all).

    Adds what the removal is to do: ``remove_from_client``, and ``blocklist`` for what does not hold what
    was asked for.  The cap is a top-k of stale items (of each partition, if one is named), so nothing is
    gathered in one task.
    """
    bad = with_reasons(queue, today, stale_days).filter(F.col("reason").isNotNull())
    ranked = bad.withColumn("priority", R.reason_priority(F.col("reason"))).withColumn("day", F.coalesce(R.day_number(F.col("added")).cast("long"), F.lit((1 << 63) - 1)))
    flagged = ranked.withColumn("remove_from_client", F.lit(True)).withColumn("blocklist", F.col("reason") != R.STALE)
    if cap > 0:
        stale = flagged.filter(F.col("reason") == R.STALE)
        if partition is None:
            stale = stale.orderBy("day", "id").limit(cap)
        else:
            # the rank is limited in each task before the shuffle
            place = F.row_number().over(Window.partitionBy(partition).orderBy("day", "id"))
            stale = stale.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
        flagged = flagged.filter(F.col("reason") != R.STALE).unionByName(stale)
    return flagged.select(*queue.columns, "reason", "priority", "day", "remove_from_client", "blocklist")
