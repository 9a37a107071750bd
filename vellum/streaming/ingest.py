"""Documents as they arrive: a stream of files, parsed batch by batch with the tables of vellum.plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, modified, content) of files, each once; at most per_trigger in a batch."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "content")


def arrivals(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents and bytes per window of modification time; what comes later than ``late`` is left out."""
    marked = stream.withWatermark("modified", late)
    return marked.groupBy(F.window("modified", window)).agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("content")).alias("bytes"))


def write_tables(stream: DataFrame, tables: Iterable[str], out: str, checkpoint: str):
    """Append the named tables of each batch below out. A batch that is run again after a failure replaces its own rows."""
    from vellum.plans.tables import Engine

    def batch(df: DataFrame, n: int) -> None:
        engine = Engine(df.select("doc_id", "content"))
        for t in tables:
            engine.table(t).write.mode("overwrite").parquet(f"{out}/{t}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
