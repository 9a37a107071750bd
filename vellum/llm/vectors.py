"""What the embedding operators share: valid vectors as an aligned matrix, and their classes of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """False for null, empty and zero vectors and for those with a null, infinite or NaN component."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & good & F.exists(vec, lambda x: x != 0), F.lit(False))


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column, all of one length, as a matrix."""
    import pyarrow as pa

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    n = len(arr)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_vectors(df: DataFrame, vec_col: str, n: int, seed: int) -> dict[int, np.ndarray]:
    """n distinct vectors at most, as a matrix for each length: a bounded sample by a hash of their content.

    Hashes beyond the share that n is of the rows are left out in the scan, so only about n rows are shuffled.
    """
    total = df.count()
    hashed = df.select(F.col(vec_col).alias("v"), F.xxhash64(F.col(vec_col), F.lit(seed)).alias("h"))
    if total > 2 * n:
        hashed = hashed.where(F.col("h").cast("double") / 2.0**64 + 0.5 < 2 * n / total)
    rows = hashed.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(n).select("v").toArrow().column(0).combine_chunks()
    sizes = np.array([len(v) for v in rows], np.int64)
    return {int(d): matrix(rows.take(np.flatnonzero(sizes == d))) for d in np.unique(sizes)}
