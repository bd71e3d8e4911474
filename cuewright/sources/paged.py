"""Paged answers of many servers as a Python data source that stops early.

A server's history comes in pages, newest first, one file a page: ``<root>/source=S/page=N/<file>``, the body
an object with ``records``.  A scan with a day limit reads a server's pages in order and stops after the
first page that holds an older record (or none at all), so the work follows the days that are asked for and
not the pages that are there.  Older records of the last page drop; records without a date stay.

Servers are independent: tasks take whole servers.  At most ``max_pages`` pages of a server are opened if that
option is above 0, and the report says where that left pages out.  The day limit
is an option, or a filter on ``day`` that Spark pushes into the scan, in which case undated records drop.
Pages are listed and read through the file system of the path, which the driver and all executors see.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from datetime import date

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

#: Pages of a server at most unless a scan says otherwise (0: all), and tasks of a scan.
MAX_PAGES, TASKS = 1000, 200
RECORDS = "source string, page int, ord int, id bigint, event_type string, day int, record string"
PAGES = "source string, opened int, stopped string"
_EPOCH = date(1970, 1, 1).toordinal()


def day_of(text: object) -> int | None:
    """Days since 1970 of the first ten characters; None if they are no date."""
    try:
        return date.fromisoformat(str(text)[:10]).toordinal() - _EPOCH if isinstance(text, str) else None
    except ValueError:
        return None


class _Servers(InputPartition):
    def __init__(self, names: Sequence[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.report = options["path"].rstrip("/"), options.get("report") == "pages"
        self.max_pages = int(options.get("max_pages", MAX_PAGES))
        self.min_day = int(options["min_day"]) if "min_day" in options else None
        self.dated, self.only = False, None

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if ":" in self.root else (fs.LocalFileSystem(), self.root)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes lower limits of ``day`` and one source; Spark applies everything else itself."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("day",) and not self.report:
                least = f.value + isinstance(f, GreaterThan)
                self.min_day, self.dated = max(least, least if self.min_day is None else self.min_day), True
            elif isinstance(f, EqualTo) and f.attribute == ("source",):
                self.only = f.value
                yield f
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = self._files()
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("source="))
        if self.only is not None:
            names = [x for x in names if x == f"source={self.only}"]
        return [_Servers(names[k::TASKS]) for k in range(min(TASKS, len(names)))]

    def read(self, partition: _Servers) -> Iterator[tuple]:
        files, root = self._files()
        for name in partition.names:
            source = name.removeprefix("source=")
            opened, stopped = 0, "the last page"
            for page in itertools.count(1):
                held = files.get_file_info(fs.FileSelector(f"{root}/{name}/page={page}", allow_not_found=True))
                body = next((x for x in held if x.is_file and x.base_name[0] not in "._"), None)
                if body is None:
                    break
                if 0 < self.max_pages < page:
                    stopped = "the page limit"
                    break
                opened += 1
                records = self._records(files, body.path)
                old = False
                for ord_, record in enumerate(records):
                    day = day_of(record.get("date")) if isinstance(record, dict) else None
                    if day is not None and self.min_day is not None and day < self.min_day:
                        old = True
                    elif not self.report and not (self.dated and day is None):
                        yield source, page, ord_, *self._fields(record), day, json.dumps(record)
                if old or not records:
                    stopped = "an older record" if old else "an empty page"
                    break
            if self.report:
                yield source, opened, stopped

    @staticmethod
    def _records(files: fs.FileSystem, path: str) -> list:
        with files.open_input_stream(path) as f:
            try:
                body = json.loads(f.read())
            except ValueError:
                return []
        records = body.get("records") if isinstance(body, dict) else None
        return records if isinstance(records, list) else []

    @staticmethod
    def _fields(record: object) -> tuple[int | None, str | None]:
        if not isinstance(record, dict):
            return None, None
        number, kind = record.get("id"), record.get("eventType")
        return (number if isinstance(number, int) and not isinstance(number, bool) else None), (kind if isinstance(kind, str) else None)


class PagedAnswers(DataSource):
    """``spark.read.format("paged_answers")``: records, or with ``report=pages`` what was opened of each server."""

    @classmethod
    def name(cls) -> str:
        return "paged_answers"

    def schema(self) -> str:
        return PAGES if self.options.get("report") == "pages" else RECORDS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def paged(spark: SparkSession, root: str, *, min_day: int | None = None, max_pages: int = MAX_PAGES, report: bool = False) -> DataFrame:
    """The records of all servers under ``root``, or what was opened of each; of all their pages if ``max_pages`` is 0."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a source with filters otherwise
    spark.dataSource.register(PagedAnswers)
    read = spark.read.format("paged_answers").option("max_pages", max_pages)
    if min_day is not None:
        read = read.option("min_day", min_day)
    return (read.option("report", "pages") if report else read).load(root)
