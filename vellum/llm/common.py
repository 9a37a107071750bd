"""Shared plumbing of the training-data operators: scratch tables, connected components, byte hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables written below the shared folder; they cut lineage, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df once and return the table read back; shuffle files of the job go as soon as it ends."""
        path = self.paths[name] = f"{self.root}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        with shuffle_cleanup(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                jpath, fs = _path(self.spark, path)
                fs.delete(jpath, True)

    def clear(self) -> None:
        try:
            jpath, fs = _path(self.spark, self.root)
            fs.delete(jpath, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows, and bytes of their values, of a small side that may be broadcast.
SMALL, SMALL_BYTES = 200_000, 64 << 20


def lookup(left: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner", salts: int | None = None) -> DataFrame:
    """left joined with a table that is small as a rule: broadcast if it has SMALL rows and SMALL_BYTES at most, else by salted keys.

    The bytes are those of the values as text, counted over all rows. salt: a hash that differs among the rows of left that
    share a key; it deals a hot key over ``salts`` tasks, a quarter of the shuffle partitions where that is more than 32.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    n, held = small.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= SMALL and held <= SMALL_BYTES:
        return left.join(F.broadcast(small), on, how)
    salts = salts or max(32, shuffle_partitions(left.sparkSession) // 4)
    left = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(small, [*on, "_salt"], how).drop("_salt")


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id in an edge.

    Alternates large-star and small-star steps until the edges are stars.  Each step is an aggregation with map-side
    combine and a join.  The least neighbours are written first: they are then a plain side of the join, which adaptive execution
    may broadcast, or split the other side of at a hub; so no neighbourhood is gathered in one task.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen, k = scratch.write(now, f"{name}-0"), None, 0
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == seen or not got[0]:
            break
        seen, k = tuple(got), k + 1
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("stack(2, b, m, a, m) as (a, b)").where("a <> b").distinct()
        now = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-low")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


# ---- hashing of byte strings, in numpy ---------------------------------------------------------------------------

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def splitmix(n: int, seed: int) -> np.ndarray:
    """n 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes of any byte range: hash(i, j) is equal for equal ranges, whatever their place."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    _bytes = splitmix(256, 7)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                cls._powers = np.cumprod(up), np.cumprod(down)
        return cls._powers

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self._bytes[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_slices(batch, column: int, limit: int = 1 << 21):
    """(rows, bytes, offsets) of a string column in pieces of about limit bytes; a longer text is a piece of its own. Nulls are empty."""
    import pyarrow as pa

    arr = batch.column(column)
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    if not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    if arr.null_count:  # a null's slot may cover stray bytes
        lens = np.where(arr.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        keep = np.repeat(arr.is_valid().to_numpy(zero_copy_only=False), np.diff(offs))
        data = data[offs[0] : offs[-1]][keep]
        offs = np.concatenate([[0], np.cumsum(lens)])
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield slice(at, end), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
