"""Choices that depend on what a machine offers, over inventory frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.releases import yes
from ..functions.text import recogniser_language

#: What names a hardware codec, and the order of execution providers.
HARDWARE = "nvenc|vaapi|qsv|videotoolbox|amf|cuvid|v4l2m2m|d3d11va|dxva2"
PROVIDERS = ("cuda", "directml", "coreml")


def inventory(codecs: DataFrame, *, only_video: bool = False, only_hardware: bool = False) -> DataFrame:
    """Codec rows with ``hardware``, by filters."""
    marked = codecs.withColumn("hardware", F.col("name").rlike(HARDWARE))
    marked = marked.filter("kind = 'video'") if only_video else marked
    return marked.filter("hardware") if only_hardware else marked


def available_encoders(encoders: DataFrame, devices: DataFrame) -> DataFrame:
    """(name, available): present and any device that it needs usable (``needs`` array, ``present``)."""
    needed = encoders.select("name", "present", F.explode_outer("needs").alias("device"))
    return needed.join(devices, "device", "left").groupBy("name").agg((F.first("present") & F.bool_or(yes(F.col("usable")))).alias("available"))


def first_choice(candidates: DataFrame, usable: Column, *group: str) -> DataFrame:
    """The first usable candidate (by ``ord``) of each group: encoders, decoders, devices."""
    return candidates.filter(usable).groupBy(*group).agg(F.min_by("name", "ord").alias("name"))


def resize_backend(requested: Column, resized: Column, prerequisites: dict[str, Column]) -> Column:
    """struct(backend, missing): software if the size stays; auto takes cuda if nothing is missing; a
    cuda request that misses something has no backend."""
    missing = F.array_compact(F.array(*(F.when(~yes(ok), name) for name, ok in prerequisites.items())))
    ready = F.size(missing) == 0
    backend = F.when(~resized | (requested == "software"), "software").when(ready, "cuda").when(requested == "auto", "software")
    return F.struct(backend.alias("backend"), F.when(resized & (requested != "software"), missing).otherwise(F.array().cast("array<string>")).alias("missing"))


def recogniser(gpu: Column, legacy_gpu: Column) -> Column:
    """Without a GPU tesseract; on an old one the third, else the fourth model generation."""
    return F.when(~yes(gpu), "tesseract").when(yes(legacy_gpu), "ppocr-v3").otherwise("ppocr-v4")


def recogniser_choice(tag: Column, default: Column, system: Column, installed: Column, engine: Column) -> Column:
    """The first of tag, default and system language, then eng; for tesseract only installed ones count."""
    codes = [recogniser_language(c) for c in (tag, default, system)]
    limited = [F.when(F.array_contains(installed, c), c) for c in (*codes, F.lit("eng"))]
    return F.when(engine == "tesseract", F.coalesce(*limited, F.array_min(installed), F.lit("eng"))).otherwise(F.coalesce(*codes, F.lit("eng")))


def provider_plan(available: dict[str, Column], require_gpu: Column) -> Column:
    """Usable providers in order, then cpu unless a GPU is required; null if one is required and none usable."""
    usable = F.array_compact(F.array(*(F.when(yes(available[p]), p) for p in PROVIDERS)))
    return F.when(yes(require_gpu), F.when(F.size(usable) > 0, usable)).otherwise(F.concat(usable, F.array(F.lit("cpu"))))


def fallback(primary: Column, secondary: Column) -> Column:
    return F.coalesce(primary, secondary, F.lit("english"))


def worker_plan(tasks: Column, parallelism: Column, cap: Column, gpus: Column, jobs_per_gpu: Column) -> Column:
    """Workers for a number of tasks: all slots of the GPUs, or the processors, within the cap and the tasks."""
    slots = F.when(gpus > 0, gpus * F.greatest(jobs_per_gpu, F.lit(1))).otherwise(parallelism)
    return F.greatest(F.least(slots, F.coalesce(cap, slots), tasks), F.lit(1))


def best_candidate(candidates: DataFrame, gain: float, *group: str) -> DataFrame:
    """An ordered choice with hysteresis: a later candidate must beat the best so far by over ``gain``.

    A group holds the few candidates of one image.
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", "quality", "name")))
    best = F.aggregate(F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0))), F.try_element_at(listed, F.lit(1)), lambda b, c: F.when(c["quality"] > b["quality"] + gain, c).otherwise(b))
    return candidates.groupBy(*group).agg(best.alias("best")).select(*group, "best.name", "best.quality")
