"""Hard negatives: k-means inverted lists that are visited by an upper bound of their inner products.

Vectors are scaled and floored to whole numbers, so scores are exact integers. K-means on a bounded sample (``sample_rows``
vectors) gives the lists; every row of the table is filed under its nearest centroid, in one of two shells around it (cut at
the sample's median distance), and each shell stores its radius: the greatest distance from the centroid of all its rows. By
Cauchy-Schwarz no row of a shell scores above a.c + |a| r for an anchor a, and none below a.c - |a| r.

An anchor visits shells by falling upper bound. That takes two rounds: the first ``first`` rows or so tell a kth score, and
the second round visits all that is left but those shells whose bound lies strictly below it. So results are exact. First the
positives are found, among the shells' rows of the anchor's label; then, for all positives of an anchor at once, the
negatives: a shell whose bounds lie outside the windows of all its positives is skipped in both rounds.

Shells are cut into parts of ``part_rows`` rows and the anchors of a shell into blocks, so no task holds more. A part and a
block meet once; what leaves is at most k rows for each anchor and window.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; zero
vectors do; vectors of other lengths than the anchor's are not its candidates; rows that repeat an id with another label or vector are
candidates each on its own, equal rows are one; an anchor's own id is no candidate of it; rows of one anchor id that differ
are anchors each; ties go to the smaller id; with fewer candidates all come back, and an anchor without positives, or a
positive without negatives, has no rows; scores beyond 64 bits are cut to the
least and greatest long; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import matrix, sample_vectors

#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
TILE = 1 << 21


def k_means(x: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """Centroids of at most k lists, none of them empty on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(steps):
        home = nearest_list(x, c)[0]
        n = np.bincount(home, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        new = sums[n > 0] / n[n > 0][:, None]
        if new.shape == c.shape and np.allclose(new, c):
            break
        c = new
    return c


def nearest_list(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list of each row, its distance from the centroid)."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (c**2).sum(1)[None, :] - 2 * x @ c.T
        home = np.where(np.isnan(far), np.inf, far).argmin(1)
        return home, np.sqrt(((x - c[home]) ** 2).sum(1))


class Lists:
    """The index's frame of one length of vectors: centroids, where shells are cut, and, once rows are filed, the shells."""

    def __init__(self, sample: np.ndarray, k: int, seed: int):
        self.c = k_means(sample, k, seed) if len(sample) else np.zeros((1, sample.shape[1]))
        home, far = nearest_list(sample, self.c) if len(sample) else (np.zeros(0, int), np.zeros(0))
        self.cut = np.array([np.median(far[home == i]) if (home == i).any() else 0.0 for i in range(len(self.c))])

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home, far = nearest_list(x, self.c)
        return home, (far > self.cut[home]).astype(np.int32), far

    def hold(self, shells: list[tuple[int, int, float, int]]) -> None:
        """shells: (list, shell, radius, rows)."""
        self.at = np.array([s[:2] for s in shells], np.int64).reshape(-1, 2)
        self.radius, self.rows = np.array([s[2] for s in shells], np.float64), np.array([s[3] for s in shells], np.int64)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of each shell's rows with a, rounding allowed for."""
        with np.errstate(over="ignore", invalid="ignore"):
            middle, size = (self.c @ a)[self.at[:, 0]], float(np.sqrt((a**2).sum()))
            reach = size * self.radius
            slack = 1 + 1e-9 * (size * np.sqrt((self.c**2).sum(1))[self.at[:, 0]] + reach)
            return np.clip(middle - reach - slack, -(2.0**63), 2.0**63), np.clip(middle + reach + slack, -(2.0**63), 2.0**63)


def first_shells(lists: Lists, upper: np.ndarray, wanted: np.ndarray, first: int) -> np.ndarray:
    """Which shells the first round visits: those wanted, by falling bound, until they hold ``first`` rows."""
    order = np.argsort(-np.nan_to_num(upper, nan=np.inf), kind="stable")
    order = order[wanted[order]]
    out = np.zeros(len(upper), bool)
    out[order[: int(np.searchsorted(np.cumsum(lists.rows[order]), first)) + 1]] = True
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where these hold them, else by whole numbers of any size, cut to 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _sides(group):
    """(rows, asks) of a piece of work; equal rows are one."""
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    rows = group.filter(~asks)
    key = np.lexsort((rows.column("h").to_numpy(), rows.column("id").to_numpy()))
    i, h = rows.column("id").to_numpy()[key], rows.column("h").to_numpy()[key]
    new = np.ones(len(key), bool)
    new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1])
    return rows.take(key[new]), group.filter(asks)


def _best_positives(k: int) -> Callable:
    def run(group):
        import pyarrow as pa

        rows, asks = _sides(group)
        ids, names, x = rows.column("id").to_numpy(), rows.column("h").to_numpy(), matrix(rows.column("v"))
        q, own, ak, floor = matrix(asks.column("v")), asks.column("id").to_numpy(), asks.column("h").to_numpy(), asks.column("low").to_pylist()
        out: list[tuple] = []
        step = max(1, TILE // max(1, len(ids)))
        for at in range(0, len(own), step):
            tile = products(q[at : at + step], x)
            for j, s in enumerate(tile, at):
                low = floor[j][0] if floor[j] else None
                can = np.flatnonzero((ids != own[j]) & (s >= low if low is not None else True))
                if len(can) > k:
                    edge = np.partition(s[can], len(can) - k)[len(can) - k]
                    can = can[s[can] >= edge]
                can = sorted(can.tolist(), key=lambda i: (-s[i], ids[i]))[:k]  # noqa: B023
                out += [(ak[j], own[j], ids[i], names[i], None, None, s[i]) for i in can]
        return _found(pa, out)

    return run


def _best_negatives(k: int) -> Callable:
    def run(group):
        import pyarrow as pa

        rows, asks = _sides(group)
        ids, names, x, labels = rows.column("id").to_numpy(), rows.column("h").to_numpy(), matrix(rows.column("v")), np.array(rows.column("label").to_pylist(), object)
        q, ak, own, own_label = matrix(asks.column("v")), asks.column("h").to_numpy(), asks.column("id").to_numpy(), asks.column("label").to_pylist()
        pid, low, high = (asks.column(c).to_pylist() for c in ("pid", "low", "high"))
        out: list[tuple] = []
        step = max(1, TILE // max(1, len(ids)))
        for at in range(0, len(own), step):
            tile = products(q[at : at + step], x)
            for j, s in enumerate(tile, at):
                can = np.flatnonzero((s >= min(low[j])) & (s <= max(high[j])))
                can = can[(labels[can] != own_label[j]) & (ids[can] != own[j])]
                can = sorted(can.tolist(), key=lambda i: (-s[i], ids[i]))  # noqa: B023
                for p, lo, hi in zip(pid[j], low[j], high[j], strict=True):
                    n = 0
                    for i in can:
                        if n == k or s[i] < lo:
                            break
                        if s[i] <= hi:
                            n += 1
                            out.append((ak[j], own[j], ids[i], names[i], p, hi, s[i]))
        return _found(pa, out)

    return run


#: ch tells candidates of one id apart.
FOUND = "h long, anchor_id long, id long, ch long, pid long, high long, score long"


def _found(pa, out: list[tuple]):
    cols = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(7)]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["h", "anchor_id", "id", "ch", "pid", "high", "score"])


def hard_negatives(scratch: Scratch, table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", lists: int | None = None, first: float = 0.05, sample_rows: int = 20_000, part_rows: int = 2048, ask_rows: int = 1024, seed: int = 23) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    window (l, h): a negative's score is l to h hundredths of its positive's. lists: their number, else a quarter of the
    root of the rows (a sixteenth of the sample at most). first: the share of the table that the first round visits.
    """
    spark = table.sparkSession

    def clean(df):
        x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * scale)
        whole = F.transform("v", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
        good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("v"))
        rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
        return rows.select("id", "label", whole.alias("v")).withColumn("h", F.xxhash64("id", "label", "v"))

    rows, asked = clean(table), scratch.write(clean(anchors).dropDuplicates(["id", "h"]), "anchors")
    total = rows.count()
    number = lists or max(1, min(int(total**0.5 / 4), sample_rows // 16))
    frames = {d: Lists(x, number, seed) for d, x in sample_vectors(rows, "v", sample_rows, seed).items()}
    frame = lambda d: frames.get(d) or Lists(np.zeros((0, d)), 1, seed)

    def file(batches):
        import pyarrow as pa

        for b in batches:
            dims = np.array([len(v) for v in b.column(2)], np.int64)
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                home, shell, far = frame(int(d)).file(matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(home), d), pa.int32()), pa.array(home, pa.int32()), pa.array(shell, pa.int32()), pa.array(far)], names=["id", "label", "v", "h", "dim", "list", "shell", "far"])

    filed = scratch.write(rows.mapInArrow(file, "id long, label string, v array<double>, h long, dim int, list int, shell int, far double"), "filed")
    held: dict[int, list] = {}
    for r in filed.groupBy("dim", "list", "shell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():  # two rows for each list
        held.setdefault(r["dim"], []).append((r["list"], r["shell"], r["r"], r["n"]))
    index = {}
    for d, shells in held.items():
        index[d] = frame(d)
        index[d].hold(sorted(shells))
    shared = spark.sparkContext.broadcast(index)
    enough = {d: max(1, int(first * sum(s[3] for s in shells))) for d, shells in held.items()}
    ROUTED = "id long, label string, v array<double>, h long, pid array<long>, low array<long>, high array<long>, dim int, list int, shell int"

    def route(last: bool):
        """Shells of each anchor: of the first round, or those of the second that no kth score rules out (low: the least scores wanted; least: what they were in the first)."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                rows_, at = [], []
                for k, r in enumerate(b.select(["v", "low", "high", "least"]).to_pylist()):
                    own = shared.value.get(len(r["v"]))
                    if own is None:
                        continue
                    lower, upper = own.bounds(np.array(r["v"], np.float64))

                    def reach(lows, lower=lower, upper=upper, highs=r["high"]):
                        # Without windows all shells are wanted, and later those that reach the kth score.
                        if not highs:
                            return ~(upper < lows[0]) if lows else np.ones(len(upper), bool)
                        return np.any([~(upper < lo) & ~(lower > hi) for lo, hi in zip(lows, highs, strict=True)], axis=0)

                    chosen = early = first_shells(own, upper, reach(r["least"]), enough[len(r["v"])])
                    if last:
                        chosen = reach(r["low"]) & ~early
                    rows_ += [k] * int(chosen.sum())
                    at.append(np.c_[np.full(int(chosen.sum()), len(r["v"])), own.at[chosen]])
                at = np.concatenate(at) if at else np.zeros((0, 3), np.int64)
                part = b.select(["id", "label", "v", "h", "pid", "low", "high"]).take(pa.array(rows_, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(at[:, i], pa.int32()) for i in range(3)]], names=[*part.schema.names, "dim", "list", "shell"])

        return run

    def meet(asks: DataFrame, keys: list[str], compare: Callable, name: str) -> DataFrame:
        asks = scratch.write(asks, f"{name}-asks")
        parts = filed.groupBy(*keys).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        blocks = asks.groupBy(*keys).agg(F.ceil(F.count("*") / ask_rows).cast("int").alias("blocks"))
        cut = scratch.write(parts.join(blocks, keys), f"{name}-cut")
        label = [] if "label" in keys else ["label"]
        none = [F.lit(None).cast("array<long>").alias(c) for c in ("pid", "low", "high")]
        right = filed.join(cut, keys).select(*keys, *label, "id", "v", "h", *none, F.lit(False).alias("asks"), F.pmod("h", F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        left = asks.join(cut, keys).select(*keys, *label, "id", "v", "h", "pid", "low", "high", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod("h", F.col("blocks")).cast("int").alias("block"))
        out = scratch.write(left.unionByName(right).groupBy(*keys, "part", "block").applyInArrow(compare, FOUND), name)
        scratch.drop(f"{name}-asks", f"{name}-cut")
        return out

    def ranked(found: DataFrame, per: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), "id", "ch"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    longs = lambda *c: F.array(*c).cast("array<long>")
    keys = ["dim", "list", "shell", "label"]
    plain = asked.select("id", "label", "v", "h", longs().alias("pid"), longs().alias("low"), longs().alias("high"), longs().alias("least"))
    one = meet(plain.mapInArrow(route(False), ROUTED), keys, _best_positives(positives), "near-1")
    kth = ranked(one, ["h"], positives).where(F.col("rank") == positives).select("h", F.col("score").alias("kth"))
    told = plain.drop("low").join(kth, "h", "left").withColumn("low", F.when(F.col("kth").isNotNull(), longs("kth")).otherwise(longs()))
    two = meet(told.mapInArrow(route(True), ROUTED), keys, _best_positives(positives), "near-2")
    near = scratch.write(ranked(one.union(two), ["h"], positives).select("h", F.col("id").alias("pid"), F.col("score").alias("high")), "positives")

    low, high = window
    # The least whole score in the window; products of hundredths and long scores are taken as decimals.
    ps = F.col("high").cast("decimal(20,0)")
    least = F.ceil(ps * low / 100).cast("long")
    most = F.floor(ps * high / 100).cast("long")
    near = near.select("h", F.struct("pid", least.alias("low"), most.alias("high"), F.col("high").alias("ps")).alias("p")).where("p.low <= p.high")
    windows = near.groupBy("h").agg(F.array_sort(F.collect_list("p")).alias("p"))  # ``positives`` entries at most
    asks = asked.join(windows, "h").select("id", "label", "v", "h", F.col("p.pid").alias("pid"), F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.low").alias("least"), "p")
    asks = scratch.write(asks, "windows")
    keys = ["dim", "list", "shell"]
    one = meet(asks.mapInArrow(route(False), ROUTED), keys, _best_negatives(negatives), "far-1")
    per = ["h", "pid", "high"]
    kth = ranked(one, per, negatives).where(F.col("rank") == negatives).groupBy("h").agg(F.collect_list(F.struct("pid", "high", "score")).alias("kth"))
    of = lambda x: F.filter("kth", lambda k: (k["pid"] == x["pid"]) & (k["high"] == x["high"]))
    lows = F.transform("p", lambda x: F.coalesce(F.get(of(x), F.lit(0))["score"], x["low"]))
    told = asks.drop("low").join(kth, "h", "left").withColumn("low", lows)
    two = meet(told.mapInArrow(route(True), ROUTED), keys, _best_negatives(negatives), "far-2")
    score = asks.select("h", F.explode("p").alias("p")).select("h", "p.pid", "p.high", F.col("p.ps").alias("positive_score"))
    best = ranked(one.union(two), per, negatives).join(score, per)
    return best.select("anchor_id", F.col("pid").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
