"""Embedding near-duplicates: an exact metric range join over the pivots' cells.

Unit vectors u, v have cosine >= c exactly if their distance is at most e = sqrt(2 - 2c).  A bounded sample of vectors
gives the pivots, LEAST_PIVOTS at least and as many as the root of the table's rows where that pays: for each number that
is a power of two the sample tells with how many others of a label a vector would be compared and to how many cells it would
go, and the cheapest is taken.  Each vector lives in the cell of its nearest pivot.  By the triangle inequality a partner of a vector in
the cell of p lies within d(own pivot) + 2e of p; and nearer than e to the plane halfway between p and its own pivot.  Sampled
pivots that coincide, or nearly so, are one pivot: the plane between them would be rounding.  A vector is replicated to the cells that this allows, and to no other.  Cells are cut into blocks of block_rows vectors, so
that a crowded cell is many tasks: a task compares one block of owners with one block of residents or guests and returns
counts of links and a spanning forest of what it linked, never the pairs.  The test itself is the cosine in double
precision; a pair lost to rounding of the distances is ruled out by a margin.

Equal vectors of one label are a class: they are compared once and counted by their number.

Defined results: null ids, null labels and unusable vectors (null, empty, zero, null or non-finite components) link with nothing,
and a row with a null id has itself (null) as component and is kept; vectors of different lengths do not link; rows that repeat a vec_id are one vertex, and each row counts as a vector of
its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .vectors import as_doubles, matrix, sample_vectors, unit_rows, usable

MARGIN = 1e-6
#: Pivots nearer than this are merged: rounding moves a plane by about 1e-15 / CLOSE, far below MARGIN.
CLOSE = 1e-3
LEAST_PIVOTS = 4
#: Vectors that pivots and their number are chosen from.
SAMPLE = 4096
#: Comparisons that take as long as sending a vector to a cell.
MOVE = 400


def near_vectors(scratch: Scratch, table: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", pivots: int | None = None, block_rows: int = 1024, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) for every row. pivots: their number, where it is not to be chosen."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine is in (0, 1]")
    reach = float(np.sqrt(2 - 2 * cosine)) + MARGIN
    label = F.col(label_col) if label_col else F.lit(0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), as_doubles(F.col(vec_col)).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    good = rows.where("ok").select("id", "label", "v", F.size("v").alias("dim"))
    classes = good.groupBy("label", "dim", "v").agg(F.min("id").alias("c"), F.count("*").alias("n"))
    # Rows of one id with different vectors share the vertex; their classes stay apart by a key of their own.
    classes = scratch.write(classes.select(F.xxhash64("label", "dim", "v").alias("k"), "label", "dim", "c", "n", "v"), "classes")
    total = classes.count()
    sample = {d: unit_rows(x) for d, x in sample_vectors(classes, "v", SAMPLE, seed).items()}
    labels = classes.select("label").distinct().count()
    chosen = {d: _apart(x[: pivots or best_number(x, reach, total, labels)]) for d, x in sample.items()}
    cells = "k long, label string, dim int, c long, n long, v array<double>, cell int, own boolean"

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            dims, ks, vs = b.column(2).to_numpy(), np.arange(b.num_rows), b.column(5)
            take, cell, own = [], [], []
            for d in np.unique(dims):
                idx = ks[dims == d]
                p = chosen.get(int(d))
                if p is None or len(p) == 1:
                    take.append(idx), cell.append(np.zeros(len(idx), np.int32)), own.append(np.ones(len(idx), bool))
                    continue
                home, goes = cells_of(unit_rows(matrix(vs.take(pa.array(idx)))), p, reach)
                i, j = np.nonzero(goes)
                take.append(idx[i]), cell.append(j.astype(np.int32)), own.append(home[i] == j)
            at = np.concatenate(take)
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(own))], names=[*b.schema.names, "cell", "own"])

    dealt = scratch.write(classes.mapInArrow(assign, cells), "cells")
    size = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("m")).select("label", "dim", "cell", F.ceil(F.col("m") / block_rows).cast("int").alias("blocks"))
    placed = dealt.join(size, ["label", "dim", "cell"]).withColumn("b", F.pmod(F.col("k"), F.col("blocks")).cast("int"))
    # a: block of owners; b: block of those they are compared with.
    left = placed.where("own").select("*", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("k", "c", "n", "v", "left", "label", "dim", "cell", F.col("b").alias("a"), F.col("o").alias("e"))
    right = placed.select("*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("k", "c", "n", "v", "left", "label", "dim", "cell", F.col("o").alias("a"), F.col("b").alias("e"))

    def compare(group):
        import pyarrow as pa

        side = group.column("left").to_numpy(zero_copy_only=False)
        k, c, n = (group.column(x).to_numpy() for x in ("k", "c", "n"))
        x = unit_rows(matrix(group.column("v")))
        i, j = np.flatnonzero(side), np.flatnonzero(~side)
        found = x[i] @ x[j].T >= cosine if len(i) and len(j) else np.zeros((len(i), len(j)), bool)
        other = k[i][:, None] != k[j][None, :]
        links = (found & other) @ n[j].astype(np.float64) if len(j) else np.zeros(len(i))
        low = _forest(found & other, c[i], c[j])
        keep = (links > 0) | (low < c[i])
        edges = np.flatnonzero(low[: len(i)] != c[i])
        lowj = _forest_other(found & other, low, c[j])
        ej = np.flatnonzero(lowj != c[j])
        out_k = np.concatenate([k[i][keep], np.zeros(len(edges) + len(ej), np.int64)])
        out_n = np.concatenate([links[keep].astype(np.int64), np.zeros(len(edges) + len(ej), np.int64)])
        out_a = np.concatenate([np.full(keep.sum(), -1), c[i][edges], c[j][ej]])
        out_b = np.concatenate([np.full(keep.sum(), -1), low[edges], lowj[ej]])
        is_edge = np.concatenate([np.zeros(keep.sum(), bool), np.ones(len(edges) + len(ej), bool)])
        return pa.table({"k": pa.array(out_k, pa.int64()), "n": pa.array(out_n, pa.int64()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "edge": pa.array(is_edge)})

    joined = left.unionByName(right).groupBy("label", "dim", "cell", "a", "e").applyInArrow(compare, "k long, n long, a long, b long, edge boolean")
    found = scratch.write(joined, "found")
    scratch.drop("cells")
    direct = found.where("not edge").groupBy("k").agg(F.sum("n").alias("links"))
    labels = connected_components(scratch, found.where("edge").select("a", "b"), "links")
    # Rows meet their class by its key; within it, every other row is a link.
    keyed = rows.withColumn("k", F.when(F.col("ok"), F.xxhash64("label", F.size("v"), "v")))
    info = classes.select("k", "c", "n").join(direct, "k", "left").join(labels.withColumnRenamed("id", "c"), "c", "left")
    info = info.select("k", F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "c").alias("component"))
    linked, lone = keyed.where("k is not null").join(info, "k"), keyed.where("k is null")
    out = linked.select("id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(lone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def cells_of(x: np.ndarray, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each row of x, rows x pivots: the cells that it must be in to meet every partner)."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
    home, rows = dist.argmin(1), np.arange(len(x))
    near = dist[rows, home][:, None]
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (dist**2 - near**2) / (2 * between)
    goes = (dist <= near + 2 * reach + MARGIN) & ~(plane > reach + MARGIN)
    goes[rows, home] = True
    return home, goes


def best_number(x: np.ndarray, reach: float, rows: int, labels: int) -> int:
    """The number of pivots that the sample says is cheapest for so many rows of so many labels."""
    tried, n, most, best = x[-1024:], min(LEAST_PIVOTS, len(x)), max(LEAST_PIVOTS, int(rows**0.5)), (np.inf, 1)
    while n <= min(most, len(x)):
        home, goes = cells_of(tried, _apart(x[:n]), reach)
        met = float((goes.sum(0) * np.bincount(home, minlength=goes.shape[1])).sum()) / len(tried) ** 2
        best = min(best, (met * rows / labels + MOVE * float(goes.sum()) / len(tried), n))
        n *= 2
    return best[1]


def _apart(p: np.ndarray) -> np.ndarray:
    """The unit vectors of p without those within CLOSE of an earlier one that stays."""
    kept: list[int] = []
    for i in range(len(p)):
        if not kept or np.linalg.norm(p[kept] - p[i], axis=1).min() > CLOSE:
            kept.append(i)
    return p[kept]


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each left vertex the smallest id that it reaches over the block's links."""
    low, none = a.copy(), np.iinfo(np.int64).max
    if not links.any():
        return low
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    m = links[np.ix_(rows, cols)]
    lo, hi = a[rows].copy(), b[cols].copy()
    while True:
        new_hi = np.minimum(hi, np.where(m, lo[:, None], none).min(0))
        new_lo = np.minimum(lo, np.where(m, new_hi[None, :], none).min(1))
        if (new_lo == lo).all() and (new_hi == hi).all():
            break
        lo, hi = new_lo, new_hi
    low[rows] = lo
    return low


def _forest_other(links: np.ndarray, low: np.ndarray, b: np.ndarray) -> np.ndarray:
    none = np.iinfo(np.int64).max
    if not links.size or not links.any():
        return b.copy()
    return np.minimum(b, np.where(links, low[:, None], none).min(0))
