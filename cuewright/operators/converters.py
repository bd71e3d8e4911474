"""Pluggable recognisers: a registry of their model files, and a table function that runs the chosen one.

``resolve`` picks each profile's model from a registry table by override, then by the order of candidates
that are there.  ``ConvertImages`` is a Python table function: SQL calls it over a table of images, Spark deals
the rows out by converter and part, and each task sets a converter up once and runs it over its rows.
Converters are small classes with one method, found by name; two plain ones that read text are here, and
callers add their own with ``converter``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.text import strip


class Line(NamedTuple):
    text: str
    left: int | None = None
    top: int | None = None
    right: int | None = None
    bottom: int | None = None


class Converter(Protocol):
    def extract(self, content: bytes, language: str | None) -> list[Line]: ...


#: Converters by name, made anew by each task that needs them.
CONVERTERS: dict[str, Callable[[], Converter]] = {}


def converter(name: str) -> Callable[[Callable[[], Converter]], Callable[[], Converter]]:
    """Adds a converter under a name."""

    def add(made: Callable[[], Converter]) -> Callable[[], Converter]:
        CONVERTERS[name] = made
        return made

    return add


_BLANK = " \t\n\x0b\x0c\r"


@converter("lines")
class TextLines:
    """Text, a line each; blank ones drop."""

    def extract(self, content: bytes, language: str | None) -> list[Line]:
        return [Line(x.strip(_BLANK)) for x in content.decode("utf-8").split("\n") if x.strip(_BLANK)]


@converter("whole")
class WholeText:
    """Text as one line, as recognisers give it that know no boxes; none if it is blank."""

    def extract(self, content: bytes, language: str | None) -> list[Line]:
        text = content.decode("utf-8").strip(_BLANK)
        return [Line(text)] if text else []


class ConvertImages:
    """Rows (image_id, part, converter, language, content) -> (image_id, converter, line, text, box, error).

    An image without lines gives no row; one whose converter is unknown or fails gives one row with the error.
    ``analyze`` has Spark deal the rows by converter and part, so ``part`` sets how many tasks a converter takes.
    """

    NEEDED = ("image_id", "part", "converter", "language", "content")
    #: ``register`` fills in those of the session, as tasks know only what is sent to them.
    known = CONVERTERS

    def __init__(self) -> None:
        self.made: dict[str, Converter] = {}

    @staticmethod
    def analyze(images: AnalyzeArgument) -> AnalyzeResult:
        if not images.isTable:
            raise ValueError("a table of images is needed")
        kinds = {f.name: f.dataType for f in images.dataType.fields}
        if missing := [c for c in ConvertImages.NEEDED if c not in kinds]:
            raise ValueError(f"the images lack {', '.join(missing)}")
        if kinds["content"] != BinaryType():
            raise ValueError("content must be binary")
        own = StructType([StructField("image_id", kinds["image_id"]), StructField("converter", StringType())])
        own = own.add("line", IntegerType()).add("text", StringType())
        for side in ("left", "top", "right", "bottom"):
            own = own.add(side, IntegerType())
        return AnalyzeResult(schema=own.add("error", StringType()), partitionBy=[PartitioningColumn("converter"), PartitioningColumn("part")], orderBy=[OrderingColumn("image_id")])

    def eval(self, row: Row) -> Iterator[tuple]:
        if row.content is None:
            return
        if row.converter not in self.made:
            if row.converter not in self.known:
                yield row.image_id, row.converter, None, None, None, None, None, None, f"there is no converter {row.converter}"
                return
            self.made[row.converter] = self.known[row.converter]()
        try:
            lines = self.made[row.converter].extract(bytes(row.content), row.language)
        except Exception as e:  # a converter's fault is the image's result
            yield row.image_id, row.converter, None, None, None, None, None, None, type(e).__name__
            return
        for k, line in enumerate(lines):
            yield row.image_id, row.converter, k, *line, None


def register(spark: SparkSession) -> None:
    """Makes ``convert_images(TABLE(...))``, with the converters there are by now, known to the session's SQL."""

    class Own(ConvertImages):
        known = dict(CONVERTERS)

    spark.udtf.register("convert_images", F.udtf(Own))


def converted(images: DataFrame, parts: int = 64) -> DataFrame:
    """``convert_images`` over images without a part."""
    spark = images.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM convert_images(TABLE({images}))", images=images.withColumn("part", F.pmod(F.hash("image_id"), F.lit(parts))))


def resolve(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(profile, converter, file, chosen, verdict) of each profile.

    ``registry`` has a row a candidate (profile, ord, converter, file, sha256, override), ``files`` (name, sha256)
    what there is.  An override must be there, else the profile is in error; it is not checked.  Otherwise the
    first candidate that is there is taken, even if its checksum differs, as the verdict then says.  A profile
    without any is missing and falls back.
    """
    there = files.select(F.col("name").alias("_name"), F.lower("sha256").alias("_sum"))
    found = registry.join(there, F.coalesce("override", "file") == F.col("_name"), "left").drop("_name")
    best = found.groupBy("profile").agg(
        F.min_by(F.struct("converter", "override", "_sum"), F.when(F.col("override").isNotNull(), F.col("ord"))).alias("o"),
        F.min_by(F.struct("converter", "file", "_sum", "sha256"), F.when(F.col("override").isNull() & F.col("_sum").isNotNull(), F.col("ord"))).alias("c"),
    )
    given, own = F.col("o").isNotNull(), F.col("c").isNotNull()
    matches = F.coalesce(F.lower(strip(F.col("c.sha256"))) == F.col("c._sum"), F.lit(False))
    return best.select(
        "profile",
        F.when(given, F.when(F.col("o._sum").isNotNull(), F.col("o.converter"))).otherwise(F.col("c.converter")).alias("converter"),
        F.when(given, F.col("o.override")).otherwise(F.col("c.file")).alias("file"),
        F.when(given, "override").when(own, "candidate").otherwise("none").alias("chosen"),
        F.when(given, F.when(F.col("o._sum").isNotNull(), "unchecked").otherwise("error")).when(~own, "missing").when(matches, "ok").otherwise("mismatch").alias("verdict"),
    )
