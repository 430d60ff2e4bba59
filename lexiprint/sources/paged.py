"""Feeds that come page by page, Atom or JSON, as a Spark data source.

A feed is a folder of pages as an API hands them out: ``page=<n>/<any file>`` with
``entries`` of ``id, title, summary, published`` (an Atom document, or a JSON object),
and below ``index`` JSON lines with ``page, first, last``, the times that a page
spans.  A few pages are a partition each; more are read several by one task,
neighbours by their size.  Filters on ``page`` and
``published`` reach the source, which leaves out pages that cannot hold a match.

    register(spark)
    spark.read.format("pagedfeed").option("kind", "atom").load(path).filter("published >= '2024-01-01'")
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Partitions that pages are not packed below, and bytes of pages that fill one; a task for each page costs more than most pages.
LEAST, FULL = 64, 4 << 20
ATOM = "{http://www.w3.org/2005/Atom}"
SCHEMA = "id string, title string, summary string, published timestamp, page int"
_ARROW = pa.schema([("id", pa.string()), ("title", pa.string()), ("summary", pa.string()), ("published", pa.timestamp("us", tz="UTC")), ("page", pa.int32())])


def _time(said: str | None) -> dt.datetime | None:
    """A time of ISO form, in UTC without a zone; null if it is none."""
    try:
        found = dt.datetime.fromisoformat((said or "").strip())
    except ValueError:
        return None
    return found.astimezone(dt.UTC) if found.tzinfo else found.replace(tzinfo=dt.UTC)


def atom_entries(data: bytes) -> Iterator[tuple[str | None, ...]]:
    """``id, title, summary, published`` of each entry; absent parts are null."""
    for entry in ElementTree.fromstring(data).iter(f"{ATOM}entry"):
        yield tuple(entry.findtext(f"{ATOM}{part}") for part in ("id", "title", "summary", "published"))


def json_entries(data: bytes) -> Iterator[tuple[str | None, ...]]:
    for entry in json.loads(data).get("entries") or ():
        yield tuple(entry.get(part) for part in ("id", "title", "summary", "published"))


KINDS = {"atom": atom_entries, "json": json_entries}


class Pages(InputPartition):
    """Pages that one task reads, each by its number and path."""

    def __init__(self, pages: list[tuple[int, str]]) -> None:
        self.pages = pages


def packed(pages: list[tuple[int, str, int]]) -> list[Pages]:
    """Neighbours of ``number, path, bytes`` together until they fill a partition; each alone if there are few."""
    full = min(FULL, sum(size for *_, size in pages) / LEAST) if len(pages) > LEAST else 0
    out, last, done = [], -1, 0
    for number, path, size in pages:
        part = int(done / full) if full else last + 1
        if part != last:
            out.append(Pages([]))
        out[-1].pages.append((number, path))
        last, done = part, done + size
    return out


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "atom")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        #: Tests of a page's (number, first time, last time).
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what bounds pages.  Spark still tests the rows, since a page that may match holds others too."""
        for f in filters:
            if test := self._page_test(f):
                self.tests.append(test)
            yield f

    @staticmethod
    def _page_test(f: Filter):
        name = getattr(f, "attribute", None)
        if name == ("page",):
            low = high = lambda number, first, last: number
        elif name == ("published",):
            low, high = lambda number, first, last: first, lambda number, first, last: last
        else:
            return None
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
            return None
        value = f.value
        if name == ("published",) and isinstance(value, dt.datetime):
            value = value.astimezone(dt.UTC) if value.tzinfo else value.replace(tzinfo=dt.UTC)
        if isinstance(f, GreaterThan):
            return lambda *p: high(*p) is None or high(*p) > value
        if isinstance(f, GreaterThanOrEqual):
            return lambda *p: high(*p) is None or high(*p) >= value
        if isinstance(f, LessThan):
            return lambda *p: low(*p) is None or low(*p) < value
        if isinstance(f, LessThanOrEqual):
            return lambda *p: low(*p) is None or low(*p) <= value
        if isinstance(f, EqualTo):
            return lambda *p: low(*p) is None or low(*p) <= value <= high(*p)
        if isinstance(f, In) and name == ("page",):
            return lambda number, *_: number in value
        return None

    def _open(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        files, root = self._open(self.path.rstrip("/"))
        listed = [x for x in files.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        spans: dict[int, tuple] = {}
        for x in listed:
            if x.path[len(root) :].startswith("/index/"):
                with files.open_input_stream(x.path) as f:
                    for line in f.read().splitlines():
                        row = json.loads(line)
                        spans[row["page"]] = _time(row.get("first")), _time(row.get("last"))
        pages = []
        for x in listed:
            part = next((p for p in x.path.split("/") if p.startswith("page=")), None)
            if part and part[5:].isdigit():
                number = int(part[5:])
                if all(test(number, *spans.get(number, (None, None))) for test in self.tests):
                    pages.append((number, x.path, x.size))
        return packed(sorted(pages))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        files, _ = self._open(self.path)
        for number, path in partition.pages:
            with files.open_input_stream(path) as f:
                data = f.read()
            rows = list(KINDS[self.kind](data)) if data.strip() else []
            columns = [list(c) for c in zip(*rows)] or [[]] * 4
            columns[3] = [_time(t) for t in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [number] * len(rows)], _ARROW)], schema=_ARROW)


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagedfeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeed)
