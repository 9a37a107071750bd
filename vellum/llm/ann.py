"""Approximate nearest neighbours: a forest of random-projection trees behind one priority queue.

The trees are fitted on a bounded sample (``sample_rows`` vectors): each inner node projects on a random direction and cuts
at the median.  Every row of the table is filed in one leaf of each tree.  A query walks all trees through one queue
ordered by the largest margin that it has crossed so far, and takes leaves until those taken hold ``share`` of the
table, counted with repeats over trees.  A leaf's task compares its vectors with the queries that reached it, by the exact
distance in double precision, and returns the best k of each; the best k overall follow from those, ties by the smaller id.

Leaves are cut into parts of ``part_rows`` vectors, and the queries of a leaf into blocks, so no task holds more.

Recall depends on share and on the data: for vectors without any cluster structure it has to be large (see README); with
share = trees every leaf is read and the search is exact.

Defined results: unusable vectors (null, empty, zero, null or non-finite components) take no part; vectors of other lengths than the query's are no
candidates; a null id is no query and no candidate; rows that repeat an id with other vectors are candidates each on
its own, equal rows are one, and none is for a query of that id; query rows of one id are one query, near to what is near to any
of its vectors; with fewer than k candidates all come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .vectors import as_doubles, matrix, sample_vectors, usable

RESULT = "query_id long, vec_id long, score double"


class Tree:
    """Arrays of one tree: node i has direction[i], cut[i] and children; a leaf has its number in leaf[i]."""

    def __init__(self, x: np.ndarray, leaf_rows: int, rng: np.random.Generator):
        self.direction, self.cut, self.kids, self.leaf, self.leaves = [], [], [], [], 0
        self._grow(x, np.arange(len(x)), leaf_rows, rng)
        self.direction = np.array(self.direction).reshape(len(self.cut), -1)

    def _grow(self, x, rows, leaf_rows, rng) -> int:
        at = len(self.cut)
        d = rng.standard_normal(x.shape[1])
        d /= np.linalg.norm(d)
        p = x[rows] @ d
        cut = float(np.median(p)) if len(p) else 0.0
        low = p < cut
        self.direction.append(d), self.cut.append(cut), self.kids.append((-1, -1)), self.leaf.append(-1)
        if len(rows) <= leaf_rows or not low.any() or low.all():
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
        else:
            self.kids[at] = (self._grow(x, rows[low], leaf_rows, rng), self._grow(x, rows[~low], leaf_rows, rng))
        return at

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        side, out, todo = x @ self.direction.T < np.array(self.cut), np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if self.leaf[at] >= 0:
                out[rows] = self.leaf[at]
                continue
            low = side[rows, at]
            todo += [(self.kids[at][0], rows[low]), (self.kids[at][1], rows[~low])]
        return out


def grow(sample: np.ndarray, trees: int, leaf_rows: int, seed: int) -> list[Tree]:
    return [Tree(sample, leaf_rows, np.random.default_rng([seed, t])) for t in range(trees)]


def leaves_of(forest: list[Tree], q: np.ndarray, sizes: dict[tuple[int, int], int], enough: float, least: int) -> list[tuple[int, int]]:
    """The leaves that the shared queue gives first, until they hold enough rows, and those of one tree the least number."""
    margins = [t.direction @ q - np.array(t.cut) for t in forest]
    queue, out, held = [(0.0, i, 0) for i in range(len(forest))], [], [0] * len(forest)
    heapq.heapify(queue)
    while queue and (sum(held) < enough or max(held) < least):
        far, i, at = heapq.heappop(queue)
        t = forest[i]
        while t.leaf[at] < 0:
            m = margins[i][at]
            near, other = t.kids[at] if m < 0 else t.kids[at][::-1]
            heapq.heappush(queue, (max(far, abs(m)), i, other))
            at = near
        if n := sizes.get((i, t.leaf[at]), 0):
            out.append((i, t.leaf[at]))
            held[i] += n
    return out


def nearest(scratch: Scratch, table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 4, leaf_share: float = 1 / 32, share: float = 1.2, sample_rows: int = 20_000, part_rows: int = 2048, query_rows: int = 512, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of table nearest to each row of queries.

    leaf_share: a leaf's part of the table; share: rows to compare with a query, as a multiple of the table's rows (the
    trees hold it ``trees`` times), whatever the table's size; k candidates at least, where there are as many.
    """
    clean = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_doubles(F.col(vec_col)).alias("v")).where(usable(F.col("v")))
    rows, asked = clean(table), clean(queries)
    sample = sample_vectors(rows, "v", sample_rows, seed)
    forests = {d: grow(x, trees, max(1, int(len(x) * leaf_share)), seed) for d, x in sample.items()}
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(forests)  # trees / leaf_share nodes of each length: no more with more rows

    def file(batches):
        import pyarrow as pa

        for b in batches:
            dims = np.array([len(x) for x in b.column(1)], np.int64) if b.num_rows else np.zeros(0, np.int64)
            for d in np.unique(dims):
                idx = np.flatnonzero(dims == d)
                part = b.take(pa.array(idx))
                forest = shared.value.get(int(d))
                x = matrix(part.column(1))
                for t in range(trees):
                    leaf = forest[t].file(x) if forest else np.zeros(len(idx), np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(idx), d), pa.int32()), pa.array(np.full(len(idx), t), pa.int32()), pa.array(leaf, pa.int32())], names=["id", "v", "dim", "tree", "leaf"])

    filed = scratch.write(rows.mapInArrow(file, "id long, v array<double>, dim int, tree int, leaf int"), "filed", "none")
    sizes = filed.groupBy("dim", "tree", "leaf").count().collect()  # a row for each leaf
    held: dict[int, dict[tuple[int, int], int]] = {}
    for r in sizes:
        held.setdefault(r["dim"], {})[(r["tree"], r["leaf"])] = r["count"]

    def route(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for q, v, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held.get(len(v), {})
                if forest := shared.value.get(len(v)):
                    found = leaves_of(forest, np.array(v), own, share * sum(own.values()) / trees, k + copies)
                else:
                    found = [x for x in own if x[0] == 0]
                out += [(q, v, len(v), t, leaf) for t, leaf in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["id", "v", "dim", "tree", "leaf"])

    # A query of an id that rows repeat has to pass by all of them to find k others.
    repeated = rows.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    asked = lookup(asked, repeated, ["id"], F.xxhash64("v"), "left").select("id", "v", F.coalesce("copies", F.lit(1)))
    asks = asked.mapInArrow(route, "id long, v array<double>, dim int, tree int, leaf int")
    parts = filed.groupBy("dim", "tree", "leaf").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    asks = scratch.write(asks, "asks")
    blocks = asks.groupBy("dim", "tree", "leaf").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    leaf = parts.join(blocks, ["dim", "tree", "leaf"])
    key = ["dim", "tree", "leaf"]
    right = filed.join(leaf, key).select("id", "v", *key, F.lit(False).alias("asks"), F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left = asks.join(leaf, key).select("id", "v", *key, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))

    def compare(group):
        import pyarrow as pa

        side = group.column("asks").to_numpy(zero_copy_only=False)
        ids, x = group.column("id").to_numpy(), matrix(group.column("v"))
        rows_, names = x[~side], ids[~side]
        qs, vs, ds = [], [], []
        for q, v in zip(ids[side], x[side], strict=True):
            d = np.sqrt(((rows_ - v) ** 2).sum(axis=1))
            d[names == q] = np.inf
            n = min(k, int(np.isfinite(d).sum()))
            if not n:
                continue
            edge = np.partition(d, n - 1)[n - 1]
            near = np.flatnonzero(d <= edge)
            near = near[np.lexsort((names[near], d[near]))][:n]
            qs.append(np.full(n, q)), vs.append(names[near]), ds.append(d[near])
        cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
        return pa.table({"query_id": pa.array(cat(qs, np.int64), pa.int64()), "vec_id": pa.array(cat(vs, np.int64), pa.int64()), "score": pa.array(cat(ds, np.float64), pa.float64())})

    near = left.unionByName(right).groupBy(*key, "part", "block").applyInArrow(compare, RESULT)
    best = near.groupBy("query_id", "vec_id", "score").agg(F.lit(1).alias("_n")).drop("_n")  # a row comes from each tree
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
