"""Shared storage and session helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none (unit tests on one machine) is a local folder set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    own = tempfile.mkdtemp(prefix="cuewright-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Folders that ``stored`` wrote in this process.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """What this process has freed goes back to the system, as far as its allocators can tell."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of ``mapInArrow`` that gives back what its task has freed.

    Python workers live on from stage to stage, and glibc keeps freed arrays under 32 MB for later ones,
    so that every worker of an executor would stay as large as its largest task.
    """

    def given_back(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return given_back


#: Text that goes to a Python worker in one Arrow batch, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are of about ``BATCH_BYTES``, unless the session names a size itself.

    Else Spark goes by 10,000 rows: with whole documents that is many MB, several times over in the
    executor's native memory, which it keeps.  Results don't depend on how rows are batched.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def claim(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """The text of a small file; where there is none, it is made with ``text``, if given, and null is returned.

    Making fails if another writer was first, in one step of the file system; then theirs is returned.
    """
    files, at = _file_system(spark, path)
    if text is not None and not files.exists(at):
        try:
            out = files.create(at, False)
        except Py4JJavaError:
            if not files.exists(at):
                raise
        else:
            out.write(bytearray(text.encode()))
            out.close()
            return None
    return spark.read.text(path, wholetext=True).first()[0] if files.exists(at) else None


def release(spark: SparkSession) -> int:
    """Removes all tables that ``stored`` wrote in this process, once no result that reads them is needed; how many."""
    n = len(_WRITTEN)
    while _WRITTEN:
        files, at = _file_system(spark, _WRITTEN.pop())
        files.delete(at, True)
    return n


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
