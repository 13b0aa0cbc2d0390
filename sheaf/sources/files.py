"""Reading files: Spark's binaryFile for any store, in batches and streams, and a `documents` source that gives pages."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader, StringEndsWith

from ..functions import text
from ..operators import convert
from ..parsers.base import ConversionError, Options


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content and name. Filters on path, length and time reach the scan; content is read
    only where it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("name", text.filename("path"))


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """The same columns for files as they land in a folder."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("name", text.filename("path"))


def dealt_by_size(files: DataFrame, target: int = 64 << 20) -> DataFrame:
    """Spreads files so that tasks have about `target` bytes each, whatever their order: sizes are known without content."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return files.repartition(max(1, -(-total // target)), "path")


class _Files(InputPartition):
    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)


class DocumentsSource(DataSource):
    """`spark.read.format("documents")`: pages of the files in a folder that driver and executors share.

    Options: path; glob; pages, tables, images, min_image_size, format; header_only (names and sizes, no content read);
    files_per_task. Filters on `name` (equal, ends with) are pushed to the listing.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        if self.options.get("header_only", "false").lower() == "true":
            return "path string, name string, length long, format string"
        return "path string, name string, page_ordinal int, page_number int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return DocumentsReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return DocumentsStream(dict(self.options))


def _options(options: dict[str, str]) -> Options:
    flag = lambda key, default="true": options.get(key, default).lower() == "true"
    chosen = tuple(int(p) for p in options.get("pages", "").split(",") if p.strip())
    return Options(options.get("format", "markdown"), chosen, flag("tables"), flag("images"), int(options.get("min_image_size", 50)), options.get("image_ref_prefix", ""))


def _listed(options: dict[str, str]) -> list[tuple[str, int, float]]:
    root, glob, found = options["path"].removeprefix("file://"), options.get("glob", "*"), []
    if os.path.isfile(root):
        return [(root, os.path.getsize(root), os.path.getmtime(root))]
    for folder, _, names in os.walk(root):
        for n in sorted(names):
            if fnmatch.fnmatch(n, glob) and not n.startswith((".", "_")):
                p = os.path.join(folder, n)
                found.append((p, os.path.getsize(p), os.path.getmtime(p)))
    return sorted(found)


def _rows(path: str, options: dict[str, str]) -> Iterator[tuple]:
    name = os.path.basename(path)
    with open(path, "rb") as f:
        if options.get("header_only", "false").lower() == "true":
            from .. import formats

            yield path, name, os.path.getsize(path), formats.detect_bytes(f.read(formats.PROBE), name)
            return
        data = f.read()
    n = 0
    try:
        for n, page in enumerate(convert.pages(data, name, _options(options)), 1):
            yield path, name, n - 1, page.page_number, page.text, None
    except ConversionError as e:
        if options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
            raise
        yield path, name, n, None, None, str(e)


class DocumentsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.tests.append(("equal", f.value))
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                self.tests.append(("ends", f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files dealt by size: the largest to the lightest task."""
        files = [f for f in _listed(self.options) if all((os.path.basename(f[0]) == v) if k == "equal" else f[0].endswith(v) for k, v in self.tests)]
        tasks = max(1, -(-len(files) // int(self.options.get("files_per_task", 64))))
        bins: list[list] = [[0, []] for _ in range(tasks)]
        for path, size, _ in sorted(files, key=lambda f: (-f[1], f[0])):
            least = min(bins, key=lambda b: b[0])
            least[0] += size + 4096
            least[1].append(path)
        return [_Files(b[1]) for b in bins]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from _rows(path, self.options)


class DocumentsStream(SimpleDataSourceStreamReader):
    """Files by the time they were written: a batch is what has landed since the last."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": -1.0, "path": ""}

    def _since(self, start: dict, end: dict | None) -> list[tuple[float, str]]:
        low = (start["time"], start["path"])
        found = sorted((t, p) for p, _, t in _listed(self.options) if (t, p) > low)
        return [f for f in found if end is None or f <= (end["time"], end["path"])]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._since(start, None)[: int(self.options.get("files_per_batch", 1000))]
        end = {"time": found[-1][0], "path": found[-1][1]} if found else start
        return iter([r for _, p in found for r in _rows(p, self.options)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for _, p in self._since(start, end) for r in _rows(p, self.options)])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentsSource)
