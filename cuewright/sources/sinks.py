"""Keyed tables, reports and data-set splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recognition import exportable_label, uses_spaces
from ..functions.text import fnv1a


def upsert(table: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, sorted by key; ``write_table`` puts it in place.

    ``max_by`` combines rows before the shuffle, so a key that is written often is no burden.
    """
    own = [c for c in table.columns if c != key]
    every = table.unionByName(new).withColumn("_row", F.struct(*own))
    return every.groupBy(key).agg(F.max_by("_row", at).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in own)).orderBy(key)


def _files(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions of a kept table, oldest first (Spark marks a finished write)."""
    files, at = _files(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at)]
    done = [p for p in names if p.getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v=")) for p in done)


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest finished version; no rows if there is none."""
    found = versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v={found[-1]}") if found else spark.createDataFrame([], schema)


def write_table(rows: DataFrame, folder: str, keep: int = 2) -> int:
    """Writes a new version beside the old ones, which readers use until it is finished; its number.

    The rows are written to a folder of their own, which then becomes the version by a rename.  Of two
    writers of one number the rename of the second does not put its folder there, which the writer sees by
    its own mark: it fails with ``FileExistsError``, and its rows are in no version.  Versions before the last
    ``keep`` are removed.
    """
    spark = rows.sparkSession
    found = versions(spark, folder)
    number, token = found[-1] + 1 if found else 1, uuid.uuid4().hex
    own, mark = f"{folder}/_new-{token}", f"_by-{token}"
    rows.write.parquet(own)
    files, at = _files(spark, f"{folder}/v={number}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files.create(path(own, mark), False).close()
    if not files.exists(at):
        files.rename(path(own), at)
    if not files.exists(path(at, mark)):  # another writer was first; a rename into its folder is taken back
        for left in (path(own), path(at, f"_new-{token}")):
            files.delete(left, True)
        raise FileExistsError(f"version {number} of {folder} was written meanwhile: read the table again and repeat the update")
    for old in [*found, number][:-keep]:
        files.delete(path(f"{folder}/v={old}"), True)
    return number


def training_samples(lines: DataFrame, mode: str = "both") -> DataFrame:
    """Line or rectangle crops that may train a recogniser: file name by label hash, and the padded box.

    ``line`` and ``rect`` rows carry text, language, bbox, kind and image_id.  Rectangles count if asked for, and
    where no line of their image passes.
    """
    good = lines.filter(exportable_label(F.col("text"), uses_spaces(F.col("language")))).withColumn("name", F.concat(fnv1a(F.col("text")), F.lit(".png")))
    per_image = good.groupBy("image_id").agg(F.bool_or(F.col("kind") == "line").alias("_has_line"))
    joined = good.join(per_image, "image_id")
    wanted = {"line": (F.col("kind") == "line") | ~F.col("_has_line"), "rect": F.col("kind") == "rect", "both": F.lit(True)}[mode]
    pad = lambda name, by: F.greatest(F.col(f"bbox.{name}") + by, F.lit(0))
    line = F.col("kind") == "line"
    box = F.struct(*(F.when(line, pad(n, by)).otherwise(F.col(f"bbox.{n}")).alias(n) for n, by in (("left", -3), ("top", -2), ("right", 3), ("bottom", 2))))
    return joined.filter(wanted).withColumn("bbox", box).drop("_has_line")


def sample_manifest(samples: DataFrame) -> DataFrame:
    """(value): a line a sample for a recogniser's list of labels, name and text parted by a tab, each once."""
    return samples.select(F.concat_ws("\t", "name", F.translate("text", "\t\r\n", "   ")).alias("value")).distinct()


def report_markdown(summary: DataFrame) -> DataFrame:
    """(markdown): a table a mode from ``evaluation.summarise_modes`` rows (a few modes and languages)."""
    cell = lambda c: F.format_string("%.4f", F.col(c))
    row = F.concat_ws(" | ", F.coalesce("language", F.lit("all")), F.col("fixture_count").cast("string"), cell("avg_cer"), cell("avg_wer"), cell("avg_similarity"), cell("pass_rate"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("whole_mode"), "language", row.alias("r")))), lambda s: F.concat(F.lit("| "), s["r"], F.lit(" |"))), "\n")
    head = "| language | n | CER | WER | similarity | pass rate |\n|---|---|---|---|---|---|\n"
    return summary.groupBy("mode").agg(F.concat(F.lit("## "), F.first("mode"), F.lit(f"\n\n{head}"), rows).alias("markdown"))


def split_labels(labels: DataFrame, *, seed: int, validation: Column, val_count: int, text: str = "text") -> DataFrame:
    """Adds split: fixed validation lines (a null flag: not fixed), filled up to ``val_count`` rows by the
    texts of smallest seeded hashes; else train.

    All rows of a text that fills up are validation, so that no text is in both; the last one may take the
    split over ``val_count``.  Texts are counted before they are ordered.
    """
    fixed_flag = F.coalesce(validation, F.lit(False))
    ranked = labels.withColumn("_h", F.xxhash64(F.lit(seed), F.col(text))).withColumn("_fixed", fixed_flag)
    missing = max(0, val_count - ranked.filter("_fixed").count())
    smallest = ranked.filter("not _fixed").groupBy("_h", text).agg(F.count("*").alias("_n")).orderBy("_h", text).limit(missing)  # val_count rows at most
    before = F.sum("_n").over(Window.orderBy("_h", text).rowsBetween(Window.unboundedPreceding, -1))
    filled = smallest.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < missing).select(F.col(text).alias("_text"), F.lit("val").alias("_val"))
    joined = ranked.join(filled, F.col(text).eqNullSafe(F.col("_text")), "left")
    return joined.select(*labels.columns, F.when(F.col("_fixed"), "val").otherwise(F.coalesce("_val", F.lit("train"))).alias("split"))
