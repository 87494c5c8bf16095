"""Page files as a data source of its own: one partition for each range of bytes, and nothing outside its folder.

:func:`load_pages` gives (file, number, text, blank, n_pages): the pages of the text files of a folder, split at form feeds
and numbered from 1.  Ranges are planned from files' sizes alone, so the driver reads none, and a long file is read by
several tasks; how many pages start in each range then numbers them.  Options: ``glob`` (names, ``*.txt``), ``names`` (files by
name, one a line, each inside the folder), ``bytes`` (of a range, 64 MB).  A page with under 30 characters has no text of
its own and is blank.  The folder must be one that the driver and all executors reach by its path.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: characters that a page with a text layer has; fixed value
LEAST = 30
BREAK = b"\f"
STEP = 1 << 16


class OutsideFolder(PermissionError):
    pass


def held(folder: str, name: str) -> str:
    """The file of a name in a folder; links and names that lead out of it are refused."""
    top, path = os.path.realpath(folder), os.path.realpath(os.path.join(folder, name))
    if os.path.isabs(name) or not path.startswith(top + os.sep):
        raise OutsideFolder(f"{name!r} is outside {folder}")
    return path


@dataclass
class Range(InputPartition):
    """Bytes of a file in which pages start."""

    file: str
    path: str
    start: int
    stop: int


def pages(part: Range) -> Iterator[str]:
    """The pages that start in a range; the last one goes on as far as it goes."""
    with open(part.path, "rb") as file:
        at, text = part.start, b""
        if part.start:
            # the page under way belongs to the range before
            file.seek(part.start - 1)
            while True:
                some = file.read(STEP)
                if not some:
                    return
                place = some.find(BREAK)
                if place >= 0:
                    at = file.tell() - len(some) + place + 1
                    break
            file.seek(at)
        text, seen = bytearray(text), 0
        while at < part.stop or at == 0 == part.start == part.stop:
            while (place := text.find(BREAK, seen)) < 0 and (some := file.read(STEP)):
                seen = len(text)
                text += some
            page, text, seen = (text[:place], text[place + 1 :], 0) if place >= 0 else (text, bytearray(), 0)
            yield page.decode("utf-8", "replace")
            if place < 0:
                return
            at += place + 1
        # a file that ends in a form feed has an empty last page
        if at == part.stop and not text and not file.read(1):
            yield ""


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*.txt")
        self.names = [n for n in options.get("names", "").split("\n") if n]
        self.size = int(options.get("bytes", 64 << 20))

    def partitions(self) -> list[Range]:
        names = self.names or sorted(n for n in os.listdir(self.folder) if fnmatch.fnmatch(n, self.glob))
        out = []
        for name in names:
            path = held(self.folder, name)
            size = os.path.getsize(path)
            edges = [*range(0, size, self.size), size] if size else [0, 0]
            out += [Range(name, path, a, b) for a, b in zip(edges, edges[1:])]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        for k, text in enumerate(pages(part)):
            blank = len(text.strip()) < LEAST
            yield part.file, part.start, k, None if blank else text, blank


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "file string, start long, place int, text string, blank boolean"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def load_pages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(file, number, text, blank, n_pages) of the text files of a folder."""
    spark.dataSource.register(PageSource)
    raw = spark.read.format("pages").options(**options).load(folder)
    counts = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    of_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select("file", "start", before.alias("before"), F.sum("n").over(of_file).cast("int").alias("n_pages"))
    return raw.join(ranges, ["file", "start"]).select("file", (F.col("before") + F.col("place") + 1).cast("int").alias("number"), "text", "blank", "n_pages")
