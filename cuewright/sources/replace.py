"""Files put in place of others, with a journal that survives a crash at any step.

A plan (plan_id, input, temp, final, backup) moves the original aside, promotes the converted file and drops
the original.  Steps are Spark jobs over all plans that stand before them: tasks rename files, and what
came of it is appended to the journal.  Each step looks at the files first, so a task or a job that runs
twice does nothing the second time.  After a crash ``recover`` ends every open plan in the new state if its
file was promoted, else in the old one; it too can run any number of times.

States: ``planned``, ``moved`` (original aside), ``promoted``, then ``done``, ``rolled back`` or ``refused`` (there
was no converted file).  Paths are of a file system that driver and executors see; its rename should be
atomic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "plan_id bigint, input string, temp string, final string, backup string"
STATE = "plan_id bigint, seq int, state string, error string"
_PATHS = ["input", "temp", "final", "backup"]


class _Files:
    """The files of one plan, by their part in it."""

    def __init__(self, paths: dict[str, str]) -> None:
        self.system, self.paths = None, {}
        for part, path in paths.items():
            self.system, self.paths[part] = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def has(self, part: str) -> bool:
        return self.system.get_file_info(self.paths[part]).type != fs.FileType.NotFound

    def move(self, was: str, now: str) -> None:
        self.system.move(self.paths[was], self.paths[now])

    def drop(self, part: str) -> None:
        if self.has(part):
            self.system.delete_file(self.paths[part])

    def restore(self) -> None:
        if self.has("backup") and not self.has("input"):
            self.move("backup", "input")


def _checked(files: _Files) -> tuple[str, str | None]:
    return ("planned", None) if files.has("temp") else ("refused", "there is no converted file")


def _moved(files: _Files) -> tuple[str, str | None]:
    if files.has("input"):
        files.move("input", "backup")
    return "moved", None


def _promoted(files: _Files) -> tuple[str, str | None]:
    try:
        if files.has("temp"):  # else an earlier try has promoted it
            files.move("temp", "final")
    except OSError as e:
        files.restore()
        return "rolled back", type(e).__name__
    return "promoted", None


def _finished(files: _Files) -> tuple[str, str | None]:
    files.drop("backup")
    return "done", None


def _rolled_back(files: _Files) -> tuple[str, str | None]:
    files.drop("temp")
    files.restore()
    return "rolled back", "stopped before the converted file was promoted"


def _recovered(files: _Files) -> tuple[str, str | None]:
    return _rolled_back(files) if files.has("temp") else _finished(files)


class Journal:
    """The plans under a folder and their states; a folder that holds a journal opens it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def plan(self, plans: DataFrame) -> None:
        """Adds plans; ids that are there already are left as they are."""
        self.spark.createDataFrame([], STATE).write.mode("append").parquet(f"{self.folder}/states")
        self.spark.createDataFrame([], PLAN).write.mode("append").parquet(f"{self.folder}/plans")
        new = plans.select("plan_id", *_PATHS).join(self.plans().select("plan_id"), "plan_id", "left_anti")
        new.write.mode("append").parquet(f"{self.folder}/plans")
        self._step(self.plans().join(self.states().select("plan_id"), "plan_id", "left_anti").withColumn("seq", F.lit(-1)), _checked)

    def plans(self) -> DataFrame:
        return self.spark.read.schema(PLAN).parquet(f"{self.folder}/plans")

    def states(self) -> DataFrame:
        """(plan_id, seq, state, error): where each plan stands."""
        every = self.spark.read.schema(STATE).parquet(f"{self.folder}/states")
        newest = every.groupBy("plan_id").agg(F.max_by(F.struct("state", "error"), "seq").alias("s"), F.max("seq").alias("seq"))
        return newest.select("plan_id", "seq", "s.state", "s.error")

    def _step(self, todo: DataFrame, act: Callable[[_Files], tuple[str, str | None]]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(r["plan_id"], r["seq"] + 1, *act(_Files({p: r[p] for p in _PATHS}))) for r in batch.to_pylist()]
                columns = zip(*made, strict=True) if made else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["plan_id", "seq", "state", "error"])

        todo.select("plan_id", "seq", *_PATHS).mapInArrow(run, STATE).write.mode("append").parquet(f"{self.folder}/states")

    def _standing(self, *states: str, only: Column | None = None) -> DataFrame:
        rows = self.states().filter(F.col("state").isin(*states)).join(self.plans(), "plan_id")
        return rows if only is None else rows.filter(only)

    def move(self, only: Column | None = None) -> None:
        """Moves the originals of planned files aside."""
        self._step(self._standing("planned", only=only), _moved)

    def promote(self, only: Column | None = None) -> None:
        """Puts the converted files in place; where that fails the original goes back."""
        self._step(self._standing("moved", only=only), _promoted)

    def finish(self, only: Column | None = None) -> None:
        """Drops the originals of promoted files."""
        self._step(self._standing("promoted", only=only), _finished)

    def commit(self) -> None:
        self.move()
        self.promote()
        self.finish()

    def recover(self) -> None:
        """Ends all open plans, in the new state or in the old one."""
        self._step(self._standing("planned", "moved", "promoted"), _recovered)
