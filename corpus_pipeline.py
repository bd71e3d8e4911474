"""Clean training text from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, language_id, line_dedup, merge_dropout, simhash
from cuewright.llm.queries import TOKENIZER
from cuewright.llm.shared import small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learnt language, with what the text is judged as in ``lang``; those judged ``und`` go.

    ``und`` are null and empty texts and those without a letter.  A label that the text contradicts, or a
    missing one, is replaced: later stages and users go by the text.  Ids may be null or repeat: each row is
    judged by its text alone.  Where no row is labelled there is nothing to judge by, and all texts with a
    letter stay as they are.
    """
    small_batches(spark)
    trained = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    if not trained.langs:
        return docs.filter(language_id.has_letter(F.col("text")))
    judged = language_id.with_language(docs, trained).filter(F.col(language_id.LANG) != "und")
    return judged.withColumn("lang", F.col(language_id.LANG)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold, cut from all but the largest id; n_chars follows.

    All rows stay; a text may become empty.  Null texts and rows of a null id stay as they are; rows that
    repeat an id count as one document.
    """
    small_batches(spark)
    return line_dedup.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Texts without words are one group.  Of rows that repeat the id that stays, the one of the smallest text
    is kept; rows of a null id only where their whole group has none.
    """
    small_batches(spark)
    return simhash.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination: those of which fewer than one word in twenty is hit.

    Null and wordless texts stay; rows that repeat an id are each judged; without items all stay.
    """
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with merge-dropout: doc_id, ids, n_pieces and lossless.

    Null and empty texts have no ids; rows that repeat an id and text get the same ids.
    """
    small_batches(spark)
    return merge_dropout.encode(docs, merge_dropout.PieceModel(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pieces", pieces)]

#: The language model of stage 1 and the keyed segmentation of stage 5 have no SQL form; ``tests/llm/test_pipeline.py``
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
