"""Image files: written, listed and read by the tasks, so that the driver holds none of their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import pgm_header

#: Folders that the files of one folder are spread over, if asked; bytes that a task hands on at once.
SHARDS, BATCH_BYTES = 256, 4 << 20


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows over all cores several times: a small table of much work a row is one task otherwise, and Spark joins small ones."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def write_images(images: DataFrame, folder: str, sharded: bool = False) -> int:
    """Writes (name, content) as files of a folder that driver and executors see; how many.

    A file is written under a name of its own and renamed, so a task that runs twice leaves one whole file.
    With ``sharded`` the files go to ``SHARDS`` folders below, by name, which tasks list side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(folder)
        files.create_dir(root)
        made = {root}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = f"{root}/{zlib.crc32(name.encode()) % SHARDS:02x}" if sharded else root
                if own not in made:
                    files.create_dir(own)
                    made.add(own)
                with files.open_output_stream(f"{own}/.{name}.{id(batch)}") as out:
                    out.write(content.as_buffer())
                files.move(f"{own}/.{name}.{id(batch)}", f"{own}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    written = images.filter(F.col("content").isNotNull()).select("name", "content").mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, name) of the files of a folder and of the folders in it whose names end so; empty and hidden ones count as none.

    One task lists the folder, many the folders in it; the names go from task to task.
    """

    def entries(paths: list[str]) -> Iterator[pa.RecordBatch]:
        files, root = _at(folder)
        start = folder[: len(folder) - len(root)] if ":" in folder else "file:"
        for path in paths:
            found = [x for x in files.get_file_info(fs.FileSelector(path or root)) if x.base_name[0] not in "._" and (x.type == fs.FileType.Directory or x.is_file and x.size and x.base_name.endswith(suffix))]
            for k in range(0, len(found), 10_000):
                some = found[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([start + x.path for x in some], pa.string()), pa.array([x.base_name for x in some], pa.string()), pa.array([x.is_file for x in some], pa.bool_())], ["at", "path", "name", "file"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3)
            yield batch.filter(own)
            for inner in entries(batch.filter(pa.compute.invert(own)).column(0).to_pylist()):
                yield inner.filter(inner.column(3))

    kind = "at string, path string, name string, file boolean"
    top = spark.range(1, numPartitions=1).mapInArrow(lambda batches: (e for b in batches for _ in range(len(b)) for e in entries([""])), kind)
    return spread(top, "path").mapInArrow(below, kind).select("at", "path", "name")


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, name, content) of the files that ``listed`` finds, read by as many tasks as there are cores for, not by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _at(folder)
        names = ["path", "name", "content"]
        for batch in batches:
            begin, held, size = 0, [], 0
            for k, at in enumerate(batch.column(0).to_pylist()):
                with files.open_input_stream(at) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(held)) for c in batch.columns[1:]), pa.array(held, pa.binary())], names)
                    begin, held, size = k + 1, [], 0
            if held:
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(held)) for c in batch.columns[1:]), pa.array(held, pa.binary())], names)

    return spread(listed(spark, folder, suffix), "path").mapInArrow(run, "path string, name string, content binary")


def pgm_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, head) of the PGM files of a folder; head is null for files that are none."""
    return read_files(spark, folder, ".pgm").select("name", "content", pgm_header(F.col("content")).alias("head"))
