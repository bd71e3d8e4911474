"""Exact dedup over a persistent index of text digests, in DataFrame operations alone.

``DigestIndex`` is a Parquet table of (digest, keep_id), bucketed and sorted by the digest, to which
batches append.  A batch's digests are counted by partial aggregation; those that the index lacks
are found by a sort-merge anti-join, which reads the index bucket by bucket without a shuffle, and
appended.  The batch's rows then look their digest up.  The digest is the SHA-256 of the text after
each run of white space became one space.

A commit is a small file that names the batches that count, made under the next number and never
written over: of two writers that began at one state the second to finish is refused and can try
again; what an attempt that failed has written is not read.

At size: rows move as (id, digest), never as texts.  A digest that a third of the rows share is one
row of the index, and its rows' look-up is a join that adaptive execution can split, as the other
side has one row a digest.  ``buckets`` should give buckets of some hundred MB (48 bytes a distinct
text); ``compact`` rewrites all batches as one, with another number of buckets if wanted.

Defined results: null texts are empty ones.  Of equal texts in a batch the smallest id stays; a text
that an earlier batch holds stays there, whatever its id.  A null id counts as larger than all
others.  Rows that repeat the id that stays are one document: ``kept`` is true for each of them, and
``unique`` returns one.  An empty batch appends nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import claim, exists, shared_dir, stored

#: Runs that one space replaces; a single space is not matched, as it stays as it is.
_RUN = r"[\x09-\x0D][\x09-\x0D\x20]*|\x20[\x09-\x0D\x20]+"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUN, " "), 256))


class DigestIndex:
    """The digests of all texts inserted so far, under one folder; a ``path`` that holds an index opens it."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint", buckets: int | None = None) -> None:
        self.spark, self.root = spark, path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.id_col, self.text_col, self.id_type = id_col, text_col, id_type
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.batches = 0, []
        self._open()

    def _open(self) -> None:
        """Reads the newest commit and declares its table to this session."""
        while (text := claim(self.spark, f"{self.root}/_commits/{self.version + 1}")) is not None:
            state = json.loads(text)
            self.version, self.batches, self.buckets, self.id_type = self.version + 1, state["batches"], state["buckets"], state["id_type"]
        self.table = f"digests_{uuid.uuid4().hex}"
        self._declare()

    def _declare(self) -> None:
        # a generation has its own folder, as a table has one number of buckets
        folder = f"{self.root}/buckets={self.buckets}"
        there = exists(self.spark, folder)
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        if there:
            self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def rows(self) -> DataFrame:
        """(digest, keep_id, batch) of the committed batches."""
        return self.spark.table(self.table).filter(F.col("batch").isin(self.batches) if self.batches else F.lit(False))

    def _append(self, rows: DataFrame, kept_batches: list[str]) -> str:
        batch = uuid.uuid4().hex
        rows.select("digest", F.col("keep_id").cast(self.id_type), F.lit(batch)).repartition(self.buckets, "digest").write.insertInto(self.table)
        batches = [*kept_batches, batch]
        if claim(self.spark, f"{self.root}/_commits/{self.version + 1}", json.dumps({"batches": batches, "buckets": self.buckets, "id_type": self.id_type})) is not None:
            raise RuntimeError(f"another writer has changed the index at {self.root}: open it again and repeat the batch")
        self.version, self.batches = self.version + 1, batches
        return batch

    def insert(self, docs: DataFrame) -> DataFrame:
        """Appends the texts that are new; per row of ``docs``: (id, digest, keep_id, group_size, kept).

        ``group_size`` counts the rows of this batch that have the text.
        """
        read = stored(docs.select(F.col(self.id_col).cast(self.id_type).alias("id"), digest(F.col(self.text_col)).alias("digest")), "digests")
        groups = stored(read.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        batch = self._append(groups.join(self.rows().hint("merge"), "digest", "left_anti"), self.batches)
        placed = groups.drop("keep_id").join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("new"))
        # written, so that both sides of the next join are shuffled and a hot digest's rows can be split
        found = read.join(stored(placed, "digests-placed"), "digest")
        return found.select("id", "digest", "keep_id", "group_size", (F.col("new") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def unique(self, docs: DataFrame) -> DataFrame:
        """Inserts ``docs`` and returns one row of each text that is new, all columns as they are."""
        kept = self.insert(docs).filter("kept").select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
        names = [f"c{k}" for k in range(len(docs.columns))]  # no name of the documents' columns can clash
        own_id, own_text = (names[docs.columns.index(c)] for c in (self.id_col, self.text_col))
        own = docs.toDF(*names).withColumn("_digest", digest(F.col(own_text)))
        rows = own.join(kept, (own._digest == kept._digest) & own[own_id].cast(self.id_type).eqNullSafe(kept._id), "left_semi")
        return rows.dropDuplicates(["_digest"]).drop("_digest").toDF(*docs.columns)

    def compact(self, buckets: int | None = None) -> DigestIndex:
        """All batches as one, in ``buckets`` buckets; a reader of the state before is not disturbed."""
        rows = self.rows().select("digest", "keep_id")
        if buckets and buckets != self.buckets:
            self.buckets, self.table = buckets, f"digests_{uuid.uuid4().hex}"
            self._declare()
        self._append(rows, [])
        return self
