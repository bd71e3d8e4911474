"""Joins by nearness in time, without a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], at: str, order: tuple[str, ...] = (), keep: list[str], strict: bool = True) -> DataFrame:
    """``left`` with the columns ``keep`` of the last ``right`` row of the same ``by`` before it (null if none).

    Rows are ordered by ``at`` and ``order``; without ``strict`` a right row at the same place counts as
    before.  Both sides are one union under one window, so each is shuffled once and no pair is made.
    """
    side = lambda df, mine, values: df.select(*by, at, *order, F.lit(mine).alias("_left"), *values)
    none = lambda df, columns: [F.lit(None).cast(df.schema[c].dataType).alias(f"_{k}") for k, c in enumerate(columns)]
    own = [c for c in left.columns if c not in (*by, at, *order)]
    lefts = side(left, True, [F.struct(*(own or [F.lit(1).alias("_1")])).alias("_row"), *none(right, keep)])
    rights = side(right, False, [F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(keep))])
    tie = F.col("_left").cast("int") * (-1 if strict else 1)
    before = Window.partitionBy(*by).orderBy(at, *order, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("_left"), F.struct(*(F.col(f"_{k}") for k in range(len(keep))))), ignorenulls=True).over(before)
    found = lefts.unionByName(rights).withColumn("_last", last).filter("_left")
    return found.select(*by, at, *order, *(F.col(f"_row.{c}").alias(c) for c in own), *(F.col(f"_last._{k}").alias(c) for k, c in enumerate(keep)))


def range_join(points: DataFrame, ranges: DataFrame, *, by: list[str], at: str, begin: str, end: str, width: float) -> DataFrame:
    """Pairs of points and half-open ranges of the same ``by`` that hold them.

    Ranges are laid over bins of ``width``, and a point has one bin, so pairs meet by equality; ``width``
    near a usual range's length keeps both the bins of a range and the strangers in a bin few.
    """
    bin_of = lambda c: F.floor(c / width)
    spread = ranges.filter(F.col(begin) < F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(begin)), bin_of(F.col(end)))))
    return points.withColumn("_bin", bin_of(F.col(at))).join(spread, [*by, "_bin"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")


def hinted(df: DataFrame, strategy: str, rows: int | None = None, most: int = 1_000_000) -> DataFrame:
    """A side with a join strategy: ``merge``, ``shuffle_hash`` or ``broadcast``, the last only for up to ``most`` rows, which are counted unless known."""
    if strategy == "broadcast":
        return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df
    return df.hint({"merge": "merge", "shuffle_hash": "shuffle_hash"}[strategy])
