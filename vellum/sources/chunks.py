"""Byte ranges of files as a data source: a large file is read by many tasks, each of which reads its range alone.

spark.read.format("file_chunks").option("size", 1 << 20).load("hdfs:///archive/large.pdf"), after register(spark).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start bigint, lead int, size int, data binary"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class ChunkReader(DataSourceReader):
    """Options: path (a file or a folder, as Arrow's file systems name it), size of a chunk, task (chunks of a task), suffix."""

    def __init__(self, options):
        from vellum.operators.scan import BEYOND

        self.path, self.beyond = options["path"], BEYOND
        self.size, self.task, self.suffix = int(options.get("size", 1 << 20)), int(options.get("task", 64)), options.get("suffix", ".pdf")

    def partitions(self):
        from pyarrow import fs

        store, top = _store(self.path)
        info = store.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        step = self.size * self.task
        return [Range(f.path, at, min(f.size, at + step)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            for start in range(partition.start, partition.end, self.size):
                lead = min(start, 1)
                f.seek(start - lead)
                yield partition.path, start, lead, self.size, f.read(self.size + lead + self.beyond)


class FileChunks(DataSource):
    @classmethod
    def name(cls):
        return "file_chunks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ChunkReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChunks)
