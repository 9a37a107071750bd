"""Best-fit packing by patterns.

Lengths fall into classes; every pattern of up to four classes that fills a sequence is enumerated; non-negative least
squares fits repeat counts to the histogram; the rounded counts are filled with pieces; what is left, and the room left
in the patterns, is packed by best fit.  All of this works on the histogram of lengths, which has max_len entries at
most whatever the corpus: runs of equal sequences, never single pieces, are planned.  A run uses up a length, a pattern or an
open group of sequences, so runs do not grow with the pieces.  Pieces meet the plan by their rank among pieces of one length
(a broadcast if the plan is as small as it always was, else a join by salted keys); ranks come from salted windows, so that a
common length is not one task.

``pack_in_order`` keeps an order of the documents: it is cut into windows of about window_tokens tokens, each is packed by
the same plan on its own, and sequences are numbered window after window, within one by their first piece.  What the first
sequences hold is therefore what the first documents of the order hold, up to a window.

Defined results: null and empty texts hold the end id alone; repeated rows are packed each on its own; a text longer than
max_len is cut into full pieces and a rest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None = 0, max_len: int = 2048, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of at most max_len ids; with_ids adds them as little-endian bytes, keep columns of docs."""

    def pieces(batches):
        import pyarrow as pa

        enc = Encoder.get(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        step = 4 * max_len
        for batch in batches:
            docs_, no, starts, lens, crcs, ids, at_row = [], [], [], [], [], [], []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = enc.encode_bytes(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    docs_.append(doc)
                    no.append(k)
                    starts.append(at // 4)
                    lens.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    at_row.append(i)
                    if with_ids:
                        ids.append(part)
            cols = [pa.array(docs_, pa.int64()), pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            if keep:
                cols, names = [*cols, *batch.select(list(keep)).take(pa.array(at_row, pa.int64())).columns], [*names, *keep]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"), *keep)
    return rows.mapInArrow(pieces, PIECES + ", ids binary" * with_ids + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active sets)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        k = int(np.argmax(w))
        if not np.isfinite(w[k]) or w[k] <= tol:
            break
        on[k] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            bad = on & (s <= 0)
            if not bad.any():
                break
            d = x[bad] - s[bad]
            step = float(np.min(np.where(d > 0, x[bad] / np.where(d > 0, d, 1), 0)))
            x = x + step * (s - x)
            on &= x > tol * 1e-3
            x[~on] = 0
            if not on.any():
                s = np.zeros(n)
                break
        x = s
    return x


def plan(histogram: dict[int, int], max_len: int, classes: int = 64, most: int = 4) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, base, offset): the pieces of that length with ranks lo..hi-1 go to the sequences base, base+1, ... at offset."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= max_len for k in left):
        raise ValueError("lengths are 1 to max_len")
    used, runs, seqs = dict.fromkeys(left, 0), [], 0
    lengths = sorted(left)
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(length: int, n: int, base: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, base, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.pop(bisect_left(lengths, length))

    def leave(base: int, n: int, space: int) -> None:
        if space > 0:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((base, n))

    if full := left.get(max_len):
        put(max_len, full, 0, 0)
        seqs = full

    # 1. Patterns of classes, fitted to the histogram.
    grain = -(-max_len // classes)
    top = max_len // grain
    count = np.zeros(top + 2)
    for k, v in left.items():
        count[min(-(-k // grain), top + 1)] += v
    present = [c for c in range(1, top + 1) if count[c]]
    if present:
        have, patterns = set(present), []
        for n in range(1, most):
            for head in combinations_with_replacement(present, n):
                rest = top - sum(head)
                if rest >= head[-1] and rest in have:
                    patterns.append((*head, rest))
        if patterns:
            a = np.zeros((len(present), len(patterns)))
            row = {c: i for i, c in enumerate(present)}
            for j, p in enumerate(patterns):
                for c in p:
                    a[row[c], j] += 1
            x = np.floor(nnls(a, count[present]) + 1e-6).astype(np.int64)
            for j in sorted(np.flatnonzero(x), key=lambda j: (len(patterns[j]), -x[j])):
                want, pattern = int(x[j]), sorted(patterns[j], reverse=True)
                while want:
                    chosen, space, need = [], max_len, {}
                    for i, c in enumerate(pattern):
                        # the longest of the class; the last one is the best fit to the space that is left
                        limit = space if i == len(pattern) - 1 else min(c * grain, space)
                        at = bisect_left(lengths, limit + 1) - 1
                        while at >= 0 and lengths[at] > (c - 1) * grain and left[lengths[at]] <= need.get(lengths[at], 0):
                            at -= 1
                        if at < 0 or lengths[at] <= (c - 1) * grain:
                            break
                        got = lengths[at]
                        chosen.append(got)
                        need[got] = need.get(got, 0) + 1
                        space -= got
                    if len(chosen) < len(pattern):
                        break
                    n = min([want, *(left[k] // m for k, m in need.items())])
                    offset = 0
                    for k in chosen:
                        put(k, n, seqs, offset)
                        offset += k
                    leave(seqs, n, space)
                    seqs, want = seqs + n, want - n

    # 2. The rest: longest first, each where it leaves the least room.
    while lengths:
        k = lengths[-1]
        while left.get(k):
            at = bisect_left(rooms, k)
            if at < len(rooms):
                space = rooms[at]
                base, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
                take = min(n, left[k])
                put(k, take, base, max_len - space)
                leave(base, take, space - k)
                leave(base + take, n - take, space) if n > take else None
            else:
                each = max_len // k
                n = left[k] // each
                if not n:
                    n, each = 1, left[k]
                for i in range(each):
                    put(k, n, seqs, i * k)
                leave(seqs, n, max_len - each * k)
                seqs += n
    return runs


def pack(scratch: Scratch, pieces: DataFrame, max_len: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (any columns with an integer ``length`` of 1 to max_len) with sequence_id and offset."""
    spark = pieces.sparkSession
    table = scratch.write(pieces, "pieces")
    found = table.groupBy("length").count().collect()  # max_len rows at most
    runs = plan({int(r["length"]): r["count"] for r in found}, max_len)
    total = sum(r["count"] for r in found)
    salts = max(32, -(-total // 20_000))
    # The pieces' columns travel in a struct, where their names cannot clash.
    bucket = F.pmod(F.xxhash64(*order), F.lit(salts))
    salted = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("_row"), F.col("length").cast("long").alias("length"), F.struct(*order).alias("_o"), bucket.alias("_b"))
    counts = salted.groupBy("length", "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "_b", before.alias("_before"))
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_b").orderBy("_o")))
    ranked = ranked.join(counts, ["length", "_b"]).select("_row", "length", F.xxhash64("_o").alias("_h"), (F.col("_before") + F.col("_n") - 1).alias("_rank"))
    runs_df = spark.createDataFrame(runs, "length long, _lo long, _hi long, _base long, _at long") if runs else spark.createDataFrame([], "length long, _lo long, _hi long, _base long, _at long")
    placed = lookup(ranked, runs_df, ["length"], F.col("_h")).where("_rank >= _lo and _rank < _hi")
    return placed.select("_row.*", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_at").alias("offset"))


def with_places(docs: DataFrame) -> DataFrame:
    """docs with _file and _row, by which its rows sort as they were written: Spark numbers part files in the order of partitions."""
    name = F.col("_metadata.file_name")
    places = {"_file": F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name), "_row": F.col("_metadata.row_index")}
    try:
        return docs.withColumns(places)
    except AnalysisException:  # rows that do not come from files
        return docs.withColumns({"_file": F.lit(""), "_row": F.monotonically_increasing_id()})


def pack_in_order(scratch: Scratch, pieces: DataFrame, max_len: int = 2048, window_tokens: int = 1 << 18) -> DataFrame:
    """pieces (with _file, _row and piece, their order, and ``length``) with sequence_id and offset; no other column begins with _."""
    table = scratch.write(pieces.withColumn("_c", F.floor(F.col("_row") / 4096)), "pieces")
    # Tokens before a piece, in two steps: within 4096 documents, then over their totals.
    sums = table.groupBy("_file", "_c").agg(F.sum("length").alias("_all"))
    sums = scratch.write(sums.select("_file", "_c", "_all", F.coalesce(F.sum("_all").over(Window.orderBy("_file", "_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "totals")
    total = sums.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    windows = max(1, round(total / window_tokens))
    width = max(1, -(-total // windows))
    inner = F.sum("length").over(Window.partitionBy("_file", "_c").orderBy("_row", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = table.withColumn("_in", F.coalesce(inner, F.lit(0))).join(sums.drop("_all"), ["_file", "_c"])
    placed = placed.withColumn("_at", F.col("_before") + F.col("_in")).withColumn("_w", F.floor(F.col("_at") / width))
    columns = [c for c in pieces.columns if c not in ("_file", "_row")]

    def fit(group):
        import pyarrow as pa

        group = group.sort_by("_at")
        length = group.column("length").to_numpy()
        by_length = np.argsort(length, kind="stable")
        values, first, count = np.unique(length[by_length], return_index=True, return_counts=True)
        start = dict(zip(values.tolist(), first.tolist(), strict=True))
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k, lo, hi, base, at in plan(dict(zip(values.tolist(), count.tolist(), strict=True)), max_len):
            rows = by_length[start[k] + lo : start[k] + hi]
            seq[rows], offset[rows] = base + np.arange(hi - lo), at
        # Rows are in order, so that the first row of a sequence is its first piece.
        found, head, back = np.unique(seq, return_index=True, return_inverse=True)
        number = np.empty(len(found), np.int64)
        number[np.argsort(head)] = np.arange(len(found))
        return group.select([*columns, "_w"]).append_column("_n", pa.array(number[back])).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    # Windows are few bytes and much work: their number deals them out, not their size.
    dealt = placed.select(*columns, "_at", "_w").repartition(max(pieces.sparkSession.sparkContext.defaultParallelism, windows // 16), "_w")
    packed = scratch.write(dealt.groupBy("_w").applyInArrow(fit, f"{schema}, _w long, _n long, offset long"), "packed")
    sizes = packed.groupBy("_w").agg((F.max("_n") + 1).alias("_s"))
    sizes = sizes.select("_w", F.coalesce(F.sum("_s").over(Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return packed.join(sizes, "_w").select(*columns, (F.col("_base") + F.col("_n")).alias("sequence_id"), "offset")
