"""Token-ID output: fixed-size id blocks, transposed into byte or bit planes, each plane compressed with zstandard.

Layout below one folder, written with Spark's own writers so that any Hadoop file system will do:

* ``blocks``: one row per block of ``block_ids`` ids (the last of a shard may be shorter): shard, block, n_ids, planes
  (one zstandard frame each), and the block's part of the document index (doc_ids, counts, open_start);
* ``shards``: the chunk index: shard, base (ids before the shard), n_ids.

Shards are ranges of the sorted documents, so a shard is written and read by one task and nothing is gathered.

Defined results: null and empty texts hold the end id alone; a null id sorts first; rows that repeat an id are kept, each
with a place of its own (ordered by a hash of the text); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_cleanup
from .tokens import Encoder

BLOCKS = "shard int, block int, n_ids int, planes array<binary>, doc_ids array<bigint>, counts array<int>, starts array<bigint>, at bigint"


def to_planes(ids: np.ndarray, mode: str, level: int) -> list[bytes]:
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    c = zstandard.ZstdCompressor(level=level)
    return [c.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    flat = [np.frombuffer(d.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes]
    if len(flat) == 32:
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in flat], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack(flat, axis=1).reshape(-1).view("<u4")


def write_token_files(docs: DataFrame, path: str, id_col: str, text_col: str, tokenizer: str, end_id: int | None = 2, block_ids: int = 1 << 16, mode: str = "byte", level: int = 3) -> None:
    """Encode every text, append end_id, and write all ids in ascending id order. mode: byte or bit planes."""
    if mode not in ("byte", "bit"):
        raise ValueError("mode is byte or bit")

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), Encoder.get(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        size, block, at, begun = 4 * block_ids, 0, 0, 0
        held, doc_ids, counts, starts = bytearray(), [], [], []

        def row():
            nonlocal block, at, held, doc_ids, counts, starts
            n = len(held) // 4
            cols = [[shard], [block], [n], [to_planes(np.frombuffer(bytes(held), "<u4"), mode, level)], [doc_ids], [counts], [starts], [at]]
            block, at = block + 1, at + n
            held, doc_ids, counts, starts = bytearray(), [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
            names = ["shard", "block", "n_ids", "planes", "doc_ids", "counts", "starts", "at"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, done = enc.encode_bytes(text.as_py()) + end, 0
                while True:
                    part = ids[done : done + size - len(held)]
                    held += part
                    done += len(part)
                    doc_ids.append(doc)
                    counts.append(len(part) // 4)
                    starts.append(begun)
                    if len(held) >= size:
                        yield row()
                    if done >= len(ids):
                        break
                begun += len(ids) // 4
        if doc_ids:
            yield row()

    # The hash splits rows of one id over tasks, too.
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")
    with shuffle_cleanup(docs.sparkSession):
        dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
        shards = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        # One row a shard: as many as the write had tasks.
        base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shards.withColumn("base", base).write.parquet(f"{path}/shards")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and with_ids its ids as little-endian bytes."""
    blocks, shards = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema("shard int, n_ids long, base long").parquet(f"{path}/shards")

    def segments(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                raw = from_planes(r["planes"], r["n_ids"]).tobytes()
                ends = 4 * np.cumsum(r["counts"])
                parts = [raw[e - 4 * n : e] for e, n in zip(ends, r["counts"], strict=True)]
                n = len(parts)
                cols = [
                    pa.array([r["shard"]] * n, pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["starts"], pa.int64()),
                    pa.array([r["block"]] * n, pa.int32()),
                    pa.array(r["counts"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["shard", "doc_id", "at", "block", "n", "crc"]
                if with_ids:
                    cols, names = [*cols, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "shard int, doc_id long, at long, block int, n long, crc long" + ", ids binary" * with_ids
    found = blocks.mapInArrow(segments, schema)
    # nth: rows of one id that have no ids of their own begin at one place; with an end id there are none.
    parts = found.groupBy("shard", "doc_id", "at").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(*(["block", "n", "crc"] + ["ids"] * with_ids)))).alias("parts"))

    @F.pandas_udf("long")
    def joined(ns, crcs):
        import pandas as pd

        return pd.Series([crc_of_parts(list(map(int, a)), list(map(int, b))) for a, b in zip(ns, crcs, strict=True)])

    whole = parts.withColumn("ids_crc32", F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]))
    single, spread = whole.where("ids_crc32 is not null"), whole.where("ids_crc32 is null").withColumn("ids_crc32", joined("parts.n", "parts.crc"))
    out = single.unionByName(spread).join(shards.select("shard", "base"), "shard")
    cols = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(F.concat(F.lit(b""), F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"))
    return out.select(*cols)


def crc_of_parts(counts: list[int], crcs: list[int]) -> int:
    """The CRC-32 of ids written in parts, from each part's own."""
    whole = crcs[0]
    for n, crc in zip(counts[1:], crcs[1:], strict=True):
        whole = _shifted(whole, 4 * n) ^ crc
    return whole


def _shifted(crc: int, n: int) -> int:
    """The register after n zero bytes: squarings of the one-bit step of the CRC polynomial."""

    def times(m, v):
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v >>= 1
            k += 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]
    for _ in range(3):
        step = [times(step, v) for v in step]
    while n:
        if n & 1:
            crc = times(step, crc)
        step = [times(step, v) for v in step]
        n >>= 1
    return crc
