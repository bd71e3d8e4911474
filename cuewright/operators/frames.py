"""Frame and raster statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import green_frame, near_solid
from ..functions.releases import yes

SAMPLES = 4096


def grid_step(width: Column, height: Column) -> Column:
    """The step of a grid with about ``SAMPLES`` points."""
    return F.greatest(F.ceil(F.sqrt(width.cast("double") * height / SAMPLES)), F.lit(1)).cast("int")


def plane_statistics(pixels: DataFrame, *, plane: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Mean and population deviation of the grid points of planes given as (x, y, value) rows."""
    step = grid_step(F.col(width), F.col(height))
    on_grid = pixels.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))
    value = F.col("value").cast("double")
    sums = on_grid.groupBy(*plane).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(value * value).alias("_squares"))
    return sums.withColumn("deviation", F.sqrt(F.greatest(F.col("_squares") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_squares")


def sampled(frames: DataFrame, *, file: str = "file_id", first: int = 120, interval: int = 15) -> DataFrame:
    """Every ``interval``-th of the first ``first`` decoded frames (a feature of the check, not a shortcut)."""
    place = F.row_number().over(Window.partitionBy(file).orderBy("frame")) - 1
    return frames.withColumn("_place", place).filter((F.col("_place") < first) & (F.col("_place") % interval == 0)).drop("_place")


def visual_report(frames: DataFrame, failure_ratio: float, *, file: str = "file_id") -> DataFrame:
    """Counts, means and the two verdicts of each file's inspected frames (mean, deviation, u, v)."""
    mean, deviation = F.col("luma_mean"), F.col("luma_deviation")
    suspicious, solid = green_frame(mean, deviation, F.col("u_mean"), F.col("v_mean")), near_solid(mean, deviation)
    counted = frames.groupBy(file).agg(
        F.count("*").alias("inspected"), F.count_if(suspicious).alias("suspicious"), F.count_if(solid).alias("solid"),
        F.avg(mean).alias("avg_luma"), F.avg("u_mean").alias("avg_u"), F.avg("v_mean").alias("avg_v"),
    )
    needed = F.greatest(F.ceil(F.col("inspected") * failure_ratio), F.lit(2))
    fails = lambda c: (F.col("inspected") >= 3) & (F.col(c) >= needed)
    return counted.withColumn("green_failure", fails("suspicious")).withColumn("solid_failure", fails("solid"))


def dominant_colour(pixels: DataFrame, *, image: str = "image_id") -> DataFrame:
    """(image, index, n): the commonest palette index of visible pixels (alpha over 16); ties to the lowest."""
    counts = pixels.filter(F.col("alpha") > 16).groupBy(image, "index").agg(F.count("*").alias("n"))
    return counts.groupBy(image).agg(F.max_by(F.struct("index", "n"), F.struct("n", -F.col("index"))).alias("_top")).select(image, "_top.index", "_top.n")


def rect_counts(rects: DataFrame, *, group: str = "stream_id") -> DataFrame:
    return rects.groupBy(group).agg(F.count("*").alias("rects"), F.count_if(F.col("kind") == "bitmap").alias("bitmap_rects"))


def retry_streams(streams: DataFrame, bitmap: tuple[str, ...]) -> DataFrame:
    """Bitmap subtitle streams with packets of which none decoded and no cue came."""
    return streams.filter((F.col("cues") == 0) & (F.col("packets") > 0) & (F.col("decoded") == 0) & F.col("codec").isin(*bitmap))


def temporal_collapse(pairs: DataFrame) -> DataFrame:
    """Adds ``collapsed`` to files with source and output structs (seconds, fps)."""
    from ..functions.media import rate_collapsed

    return pairs.withColumn("collapsed", rate_collapsed(F.col("source"), F.col("output")))


def throughput(runs: DataFrame) -> DataFrame:
    """fps, realtime and speed-up of runs (packets, seconds, duration, base_seconds); 0 where nothing elapsed."""
    ran = yes(F.col("seconds") > 0)
    over = lambda c: F.when(ran, F.col(c) / F.col("seconds")).otherwise(0.0)
    return runs.withColumn("fps", over("packets")).withColumn("realtime", over("duration")).withColumn("speedup", over("base_seconds"))
