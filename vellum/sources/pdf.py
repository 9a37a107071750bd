"""Where documents come from: files, binary columns, and streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(doc_id, path, length, content) of files; content is only read where a plan uses it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def documents(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", password_col: str | None = None) -> DataFrame:
    """Any table with a binary column as documents."""
    password = F.col(password_col).cast("string") if password_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content"), password.alias("password"))


def spread(docs: DataFrame, target_bytes: int = 32 << 20) -> DataFrame:
    """Documents dealt out by size before parsing: a large one has a task of its own, and small ones share tasks by a hash.

    Sizes come from the column length, where there is one, so no content is read for them.
    """
    size = F.coalesce(F.col("length") if "length" in docs.columns else F.octet_length("content"), F.lit(0)).cast("long")
    large = size >= target_bytes
    n_large, rest = docs.agg(F.count(F.when(large, 1)), F.coalesce(F.sum(F.when(~large, size)), F.lit(0))).first()
    tasks = max(1, -(-rest // target_bytes))
    if not n_large:
        return docs.repartition(tasks)
    # Numbers of the large ones: ids alone meet for them.
    order = F.row_number().over(Window.orderBy("doc_id")) - 1
    numbers = docs.where(large).select("doc_id").distinct().select("doc_id", order.alias("_nth"))
    dealt = docs.join(F.broadcast(numbers) if n_large < 100_000 else numbers, "doc_id", "left")
    part = F.when(F.col("_nth").isNotNull(), F.col("_nth")).otherwise(n_large + F.pmod(F.xxhash64("doc_id"), F.lit(tasks)))
    return dealt.withColumn("_part", part.cast("int")).repartitionById(n_large + tasks, "_part").drop("_part", "_nth")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system: Spark's default one, where it names none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def write_files(docs: DataFrame, path: str) -> DataFrame:
    """One file per document, ``<doc_id>.pdf`` below path, and a table of what was written in ``path/_written``, which is returned.

    path: a folder that all executors reach, on Spark's default file system if it names none (any that Arrow opens by its name). A file is written aside and then
    renamed, so a task that is run again, or twice, leaves whole files only. Documents without bytes have no file.
    """

    path = qualified(docs.sparkSession, path)

    def put(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, name = content.as_py(), f"{doc_id}.pdf"
                aside = f"{top}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(data)
                store.move(aside, f"{top}/{name}")
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "name", "bytes"])

    rows = docs.where("content is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "content")
    schema = "doc_id long, name string, bytes long"
    rows.mapInArrow(put, schema).write.mode("errorifexists").parquet(f"{path}/_written")
    return docs.sparkSession.read.schema(schema).parquet(f"{path}/_written")
