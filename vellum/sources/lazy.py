"""Objects of files without reading the files: the tail, the cross-reference sections, and the extents of what is asked for.

    register(spark)
    spark.read.format("pdf_objects").load("hdfs:///archive/").where("num = 5")

Filters on num reach the reader, so of a file of any size only the ranges that lead to those objects are read; bytes_read
says how many that were. Files without a usable table are read whole, as their objects have to be searched for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from vellum.core.document import Document
from vellum.core.objects import Lexer, PdfError, Ref
from vellum.sources.chunks import _store

SCHEMA = "path string, num bigint, gen bigint, kind string, value string, data binary, bytes_read bigint"
#: What is first read of a tail and of a section; more follows where that does not do.
TAIL, SECTION = 2048, 16384


class Ranges:
    """A file as something of a length that can be sliced; counts what it reads."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self.fetch, self.size, self.read = fetch, size, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        got = self.fetch(start, max(0, stop - start))
        self.read += len(got)
        return got


class RangeDocument(Document):
    """A document that is read by ranges, as far as it is asked for."""

    def __init__(self, ranges: Ranges, password: str | None = None):
        self.ranges, self.whole = ranges, False
        super().__init__(ranges, password)

    def _within(self, data: bytes, run: Callable):
        self.data = data
        try:
            return run()
        finally:
            if not self.whole:
                self.data = self.ranges

    def _read_header(self) -> tuple[str, str]:
        return self._within(self.ranges[:1024], super()._read_header)

    def _tail(self) -> tuple[int, int]:
        window, size = TAIL, len(self.ranges)
        while True:
            data = self.ranges[max(0, size - window) :]
            if window >= size or len(re.findall(rb"[^\r\n]+", data)) > 3:
                start, end = self._within(data, super()._tail)
                return start, end + size - len(data)
            window *= 8

    def _grown(self, start: int, first: int, run: Callable[[bytes], object]):
        """What run makes of a range from start on, of which more is read while it fails for want of bytes."""
        window, size = first, len(self.ranges)
        while True:
            try:
                return run(self.ranges[start : start + window])
            except PdfError:
                if start + window >= size:
                    raise
                window *= 4

    def _section(self, at: int):
        if not 0 <= at < len(self.ranges):
            raise PdfError("xrefNotFound", at, at)
        base = super()._section
        return self._grown(at, SECTION, lambda data: self._within(data, lambda: base(0)))

    def _recover(self) -> None:
        self.data, self.whole = self.ranges[:], True
        super()._recover()

    def read(self, ref: Ref, place: tuple):
        if self.whole or place[0] == "packed":
            return super().read(ref, place)
        start = place[1]
        extent = max(32, self._extent.get(start, len(self.ranges)) - start)
        found, obj = self._grown(start, extent, lambda data: self._indirect(Lexer(data, 0, len(data))))
        if found != ref:
            raise PdfError("objectNotFound", start, start + extent, ("indirectObject", *ref))
        return obj

    def newest(self, nums: frozenset[int] | None) -> Iterator[tuple[Ref, object]]:
        for ref in sorted(self._layout):
            if nums is None or ref.num in nums:
                try:
                    yield ref, self.get(ref)
                except PdfError as e:
                    self.fail(e, ("indirectObject", *ref))


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class ObjectReader(DataSourceReader):
    """Options: path, as Arrow's file systems name it; suffix; password; files (of a task)."""

    def __init__(self, options):
        self.path, self.suffix, self.password, self.files = options["path"], options.get("suffix", ".pdf"), options.get("password"), int(options.get("files", 32))
        self.nums: frozenset[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("num",):
                asked = frozenset(f.value if isinstance(f, In) else (f.value,))
                self.nums = asked if self.nums is None else self.nums & asked
            yield f  # Spark looks again, so that nulls and types are its own matter

    def partitions(self):
        from pyarrow import fs

        store, top = _store(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        found = [(f.path, f.size) for f in sorted(found, key=lambda f: f.path)]
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition):
        import json

        from vellum.core.document import tagged, type_name
        from vellum.core.objects import Stream

        store, _ = _store(self.path)
        for path, size in partition.files:
            with store.open_input_file(path) as f:

                def fetch(start: int, n: int, f=f) -> bytes:
                    f.seek(start)
                    return f.read(n)

                ranges = Ranges(fetch, size)
                for ref, x in RangeDocument(ranges, self.password).newest(self.nums):
                    yield path, ref.num, ref.gen, type_name(x), json.dumps(tagged(x), ensure_ascii=False), x.data if isinstance(x, Stream) else None, ranges.read


class Objects(DataSource):
    @classmethod
    def name(cls):
        return "pdf_objects"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ObjectReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Objects)
