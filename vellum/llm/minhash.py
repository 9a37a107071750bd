"""MinHash near-duplicates through a multi-index Hamming join.

A document's signature has k symbols of b = 16 bits, one per hash function.  Documents with Jaccard similarity s differ in a
binomial number of symbols with mean k (1 - s); the distance threshold t lies so far above the mean at the similarity
asked for that a pair is missed with probability below 1e-5 (less the more similar it is).  Within t nothing is missed: by pigeonhole, if the symbols fall
into chunks with e_i allowed errors and the e_i + 1 add up to more than t, some chunk of such a pair has e_i errors at
most.  Errors are enumerated by leaving symbols out: every subset of a chunk with e_i symbols less is a key.

Documents of equal shingle sets are one class from the start.  A key's members are first compared with one of them only
(a star), so a group of copies gives one pair each; whoever that leaves apart is then compared with the other members of
the key, where they are, and a spanning forest of what lies within the signature distance leaves the task.  The components
of all that are groups; every pair within the distance lies inside one.  The members of a group meet once with their full
shingle sets (64-bit hashes), whose exact similarity decides, and leave with a label.  So rows grow with the members of a
group and not with its pairs, however many of those are near copies just below the similarity asked for.

Words are runs of bytes other than white space (space, tab to carriage return) after lower-casing A-Z; a set holds the
distinct runs of ``words`` words; a shorter text is one shingle; null texts and those without words are empty sets.

Defined results: empty sets link with nothing; a null id has itself (null) as component and is kept; rows that repeat an id
are one vertex, and each comes back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, mix, splitmix, text_slices

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunk_plan(k: int, threshold: int, errors: int = 1) -> list[tuple[range, int]]:
    """Chunks of the k symbols with their allowed errors, so that errors + 1 add up to more than threshold."""
    n = threshold // (errors + 1) + 1
    if n > k:
        raise ValueError("fewer symbols than chunks")
    cut = [i * k // n for i in range(n + 1)]
    return [(range(a, b), min(errors, b - a - 1)) for a, b in zip(cut, cut[1:], strict=False)]


def threshold_of(k: int, similarity: float, miss: float = 1e-5) -> int:
    """The least t with P(more than t of k symbols differ) < miss at that similarity."""
    p, q = 1 - similarity, similarity
    term, total, x = q**k, 0.0, 0
    while x < k:
        total += term
        if 1 - total < miss:
            return x
        term *= (k - x) / (x + 1) * p / q
        x += 1
    return k


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[begin:end], eight bytes a step.

    Each step mixes what it has with the next bytes, so no pattern of bytes cancels out; words of up to eight bytes and one length never
    share a hash.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - begin
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, live = 0, np.arange(len(begin))
        while len(live):
            h[live] = mix(h[live] ^ (eight[begin[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]))
            at += 8
            live = live[size[live] > at] if at < LONG_WORD else live[:0]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return h


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each distinct shingle, its 64-bit hash), sorted by both."""
    n_docs, data = len(offs) - 1, LOWER[data]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_at = offs[:-1][offs[:-1] < len(data)]
    first[starts_at] = word[starts_at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = offs[1:][offs[1:] > 0] - 1
    last[ends_at] = word[ends_at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return none
    h = word_hashes(data, begin, end)
    doc = np.searchsorted(offs, begin, side="right") - 1
    count = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        c = np.uint64(0xD6E8FEB86659FD93)
        n = max(len(h) - words + 1, 0)
        run = np.zeros(n, np.uint64)
        for j in range(words):
            run = run * c + h[j : j + n]
        run = mix(run)
        same = doc[:n] == doc[words - 1 : words - 1 + n]
        out_d, out_h = [doc[:n][same]], [run[same]]
        for d in np.flatnonzero((count > 0) & (count < words)):
            v = np.uint64(count[d])
            for x in h[at[d] : at[d + 1]]:
                v = v * c + x
            out_d.append(np.array([d])), out_h.append(mix(np.array([v], np.uint64)))
    d, s = np.concatenate(out_d), np.concatenate(out_h)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]


def signatures(d: np.ndarray, s: np.ndarray, n_docs: int, k: int, seed: int) -> np.ndarray:
    """n_docs x k symbols of 16 bits (0 for empty sets)."""
    out = np.zeros((n_docs, k), np.uint16)
    if not len(d):
        return out
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    x = (s >> np.uint64(32)).astype(np.uint32)
    a, b = splitmix(k, seed) | np.uint64(1), splitmix(k, seed + 1)
    with np.errstate(over="ignore"):
        for j in range(k):
            v = x * np.uint32(a[j] & np.uint64(0xFFFFFFFF)) + np.uint32(b[j] & np.uint64(0xFFFFFFFF))
            m = np.minimum.reduceat(v, start)
            m = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[d[start], j] = (m ^ (m >> np.uint32(13))).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, plan: list[tuple[range, int]]) -> np.ndarray:
    """n_docs x keys: a hash of the chunk's number, the symbols kept and their places."""
    cols, no = [], 0
    with np.errstate(over="ignore"):
        for symbols, errors in plan:
            for kept in combinations(symbols, len(symbols) - errors):
                no += 1
                v = np.full(len(sig), no, np.uint64)
                for j in kept:
                    v = v * np.uint64(0x9E3779B97F4A7C15) + sig[:, j]
                    v ^= v >> np.uint64(29)
                cols.append(mix(v))
    return np.stack(cols, axis=1).view(np.int64) if cols else np.zeros((len(sig), 0), np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, k: int, plan, seed: int) -> DataFrame:
    """(id, n, s1, s2, keys, sig): the set's size, a 128-bit hash of the set, the index keys and the signature."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for rows, data, offs in text_slices(batch, 1):
                n = rows.stop - rows.start
                d, s = shingle_hashes(data, offs, words)
                size = np.bincount(d, minlength=n)
                with np.errstate(over="ignore"):
                    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    np.add.at(one, d, mix(s)), np.add.at(two, d, mix(s ^ np.uint64(0x5BF03635)))
                sig = signatures(d, s, n, k, seed)
                keys = chunk_keys(sig, plan)
                m = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(rows.start, n),
                        pa.array(size, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(keys.reshape(-1))),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["id", "n", "s1", "s2", "keys", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>, sig binary")


def near_duplicates(scratch: Scratch, docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text", words: int = 5, k: int = 96, threshold: int | None = None, errors: int = 1, seed: int = 3, block: int = 1024, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_shingles, component_id, kept). similarity: linked if intersection * b >= a * union for (a, b).

    block, block_bytes: members, and bytes of their sets, that a piece of work takes from one group.
    """
    num, den = similarity
    limit = threshold_of(k, num / den) if threshold is None else threshold
    plan = chunk_plan(k, limit, errors)
    table = scratch.write(sketch(docs, id_col, text_col, words, k, plan, seed), "sketch")
    sets = table.select("id", "n", "s1", "s2").where("n > 0 and id is not null")
    classes = scratch.write(sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = table.join(classes, ["s1", "s2", "n"]).where("id = rep").select("id", "s1", "s2", "n", "keys", "sig").dropDuplicates(["id", "s1", "s2"])
    # Rows that repeat an id with other texts are other classes: cls tells them apart.
    reps = scratch.write(reps.withColumn("cls", F.xxhash64("id", "s1", "s2")), "reps")
    # Any member can be a key's star; the least class number needs no more than a hash aggregate.
    keyed = reps.select("cls", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("cls").alias("m"), F.max("cls").alias("x")).where("m < x").select("key", "m")
    buckets = scratch.write(keyed.join(low, "key").where("cls <> m").select("key", "cls", "m"), "buckets")
    first = buckets.groupBy("m", "cls").agg(F.lit(1).alias("_one")).select(F.col("m").alias("a"), F.col("cls").alias("b"))
    close = scratch.write(_close(first, reps, limit, k), "close")
    more = scratch.write(_open_forest(scratch, buckets, close, reps, limit, k, block), "open")
    groups = connected_components(scratch, close.union(more), "groups").select(F.col("id").alias("cls"), F.col("component").alias("grp"))
    scratch.drop("buckets", "open")
    found = _exact(scratch, docs, reps, groups, id_col, text_col, words, num, den, block, block_bytes)
    label = _labels(scratch, sets, reps, found)
    low = label.groupBy("label").agg(F.min("id").alias("component"))
    names = label.join(low, "label").select("s1", "s2", "n", "component")
    out = table.select("id", "n", "s1", "s2").join(names, ["s1", "s2", "n"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _close(pairs: DataFrame, reps: DataFrame, limit: int, k: int) -> DataFrame:
    """Pairs (a, b) of classes whose signatures differ in ``limit`` symbols at most."""
    a, b = reps.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))

    def near(batches):
        import pyarrow as pa

        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint16).reshape(-1, k) for i in (2, 3))
            yield t.filter(pa.array((x != y).sum(axis=1) <= limit)).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")


def _in_units(rows: DataFrame, key: str, own: str, parts: int) -> DataFrame:
    """rows (with ``blocks`` of their key) once for each pair x <= y of blocks that theirs is in; part deals the pairs out."""
    rows = rows.withColumn("b", F.pmod(own, F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")})
    return rows.withColumn("part", F.pmod(F.xxhash64(key, "x", "y"), F.lit(parts)))


def _cuts(*columns: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(order, cuts): rows sorted by the columns, and where equal ones begin, with the end."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, [*np.flatnonzero(new).tolist(), len(order)]


def _open_forest(scratch: Scratch, buckets: DataFrame, close: DataFrame, reps: DataFrame, limit: int, k: int, block: int) -> DataFrame:
    """Edges (a, b) within the signature distance that join what a key's members form beside its star.

    Members that are close to the star are one tree already.  The others of the key are compared where they are, with them
    and among themselves; a spanning forest leaves the task, so what comes out grows with the members and not with their
    pairs.  A crowded key is cut into blocks, each pair of which is a piece of work, so no key is one task.
    """
    held = buckets.join(close.select(F.col("a").alias("m"), F.col("b").alias("cls"), F.lit(False).alias("open")), ["m", "cls"], "left")
    held = scratch.write(held.select("key", "cls", F.coalesce("open", F.lit(True)).alias("open")), "held")
    size = held.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("n > 1 and any").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = held.join(size, "key").join(reps.select("cls", "sig"), "cls")
    parts = max(256, reps.count() // 500)  # a part holds many small pieces of work
    schema = "a long, b long"

    def compare(group):
        import pyarrow as pa

        key, x, y, b, cls = (group.column(c).to_numpy() for c in ("key", "x", "y", "b", "cls"))
        is_open = group.column("open").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, k)
        order, cuts = _cuts(key, x, y)
        edges: set[tuple[int, int]] = set()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = order[lo:hi]
            tree = np.where(is_open[at], np.arange(len(at)), -1)  # -1: the star's
            side, own = b[at], sig[at]
            for i in np.flatnonzero(is_open[at]).tolist():
                other = np.flatnonzero(tree != tree[i])
                if x[at[0]] != y[at[0]]:
                    other = other[side[other] != side[i]]
                near = other[(own[other] != own[i]).sum(axis=1) <= limit]
                for j in near.tolist():
                    if tree[j] != tree[i]:
                        p, q = int(cls[at[i]]), int(cls[at[j]])
                        edges.add((min(p, q), max(p, q)))
                        tree[tree == max(tree[i], tree[j])] = min(tree[i], tree[j])
        a, c = ([e[n] for e in edges] for n in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    return _in_units(rows, "key", "cls", parts).groupBy("part").applyInArrow(compare, schema).groupBy("a", "b").agg(F.lit(1).alias("_one")).drop("_one")


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, chunk: int = 2048) -> np.ndarray:
    """left x right (or left x left): is den * intersection >= num * union? Sets are sorted arrays of distinct hashes."""
    both = left if right is None else left + right
    size, n = np.array([len(s) for s in both], np.int64), len(left)
    many = len(both) > 12
    if many:
        values = np.concatenate(both)
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(both)), size)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        owner, column = owner[shared], number[column[shared]]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        common = np.zeros((n, len(both) if right is None else len(right)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
            a, b = np.searchsorted(column, [at, at + chunk])
            m = np.zeros((len(both), chunk), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            common += m[:n] @ (m if right is None else m[n:]).T
        common = common.astype(np.int64)
    else:
        right_ = left if right is None else right
        common = np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in right_] for p in left], np.int64).reshape(n, len(right_))
    total = size[:n, None] + (size if right is None else size[n:])[None, :]
    return (common > 0) & (den * common >= num * (total - common))


def least_labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number that each row (of a) and column (of b) reaches over the links."""
    lo, hi, none = a.copy(), b.copy(), np.iinfo(np.int64).max
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    m = linked[np.ix_(rows, cols)]
    while m.size:
        new_hi = np.minimum(hi[cols], np.where(m, lo[rows][:, None], none).min(0))
        new_lo = np.minimum(lo[rows], np.where(m, new_hi[None, :], none).min(1))
        if (new_lo == lo[rows]).all() and (new_hi == hi[cols]).all():
            break
        lo[rows], hi[cols] = new_lo, new_hi
    return lo, hi


def _exact(scratch: Scratch, docs: DataFrame, reps: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, block: int, block_bytes: int) -> DataFrame:
    """(cls, label, whole): the least class that a class reaches by exact links; whole tells that it is final.

    The members of a group meet once with their full sets and are compared there; labels leave the task, never pairs.  A
    group of more than a block is cut: each pair of blocks is a piece of work of its own, whose labels are edges.
    """
    sized = groups.join(reps.select("cls", "id", "s1", "s2", "n"), "cls")
    cut = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / block_bytes)).cast("int").alias("blocks")).where("blocks > 1")
    wanted = scratch.write(sized.join(cut, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "wanted")
    asked = wanted.select("id", "s1", "cls", "grp", "blocks").hint("merge")  # grows with the documents: the same plan at every size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(asked, "id")

    def full_sets(batches):
        import pyarrow as pa

        for batch in batches:
            s1 = batch.column(2).to_numpy()
            for at, data, offs in text_slices(batch, 1):
                d, s = shingle_hashes(data, offs, words)
                total = np.zeros(len(offs) - 1, np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(total, d, mix(s))
                # Rows of one id may hold several texts: that of the class has its set's hash.
                right = total.view(np.int64) == s1[at]
                ends = np.searchsorted(d, np.arange(len(offs) - 1), side="right")
                begins = np.concatenate([[0], ends[:-1]])
                blobs = [s[i:j].tobytes() if ok else None for i, j, ok in zip(begins.tolist(), ends.tolist(), right.tolist(), strict=True)]
                part = batch.slice(at.start, len(blobs)).select(["cls", "grp", "blocks"])
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], names=["cls", "grp", "blocks", "set"])
                yield out.filter(pa.array(right))

    sets = rows.select("id", "t", "s1", "cls", "grp", "blocks").mapInArrow(full_sets, "cls long, grp long, blocks int, set binary")
    total = wanted.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0)), F.count("*")).first()
    parts = int(max(48, -(-total[0] * 8 // block_bytes), total[1] // 2000))

    def compare(group):
        import pyarrow as pa

        grp, x, y, b, cls, blocks = (group.column(c).to_numpy() for c in ("grp", "x", "y", "b", "cls", "blocks"))
        blobs = group.column("set")
        order, cuts = _cuts(grp, x, y, cls)
        order = order[cuts[:-1]]  # rows that repeat a document are one
        again, cuts = _cuts(grp[order], x[order], y[order])
        order = order[again]
        out_c, out_l, out_w = [], [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = order[lo:hi]
            if len(at) < 2:
                continue
            mine = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in at.tolist()]
            if x[at[0]] == y[at[0]]:
                label, _ = least_labels(linked_pairs(mine, None, num, den), cls[at], cls[at])
            else:
                first = b[at] == x[at[0]]
                label = cls[at].copy()
                if first.any() and not first.all():
                    sides = [[s for s, f in zip(mine, first.tolist(), strict=True) if f is want] for want in (True, False)]
                    label[first], label[~first] = least_labels(linked_pairs(*sides, num, den), cls[at][first], cls[at][~first])
            keep = label != cls[at]
            out_c.append(cls[at][keep])
            out_l.append(label[keep])
            out_w.append(blocks[at][keep] == 1)
        c, v, w = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((out_c, np.int64), (out_l, np.int64), (out_w, bool)))
        return pa.table({"cls": pa.array(c, pa.int64()), "label": pa.array(v, pa.int64()), "whole": pa.array(w, pa.bool_())})

    return scratch.write(_in_units(sets, "grp", "cls", parts).groupBy("part").applyInArrow(compare, "cls long, label long, whole boolean"), "exact")


def _labels(scratch: Scratch, sets: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """(id, s1, s2, n, label) of every class; classes that share an id, whose rows hold several texts, have one label."""
    known, cut = found.where("whole").select("cls", "label"), found.where("not whole")
    if not cut.isEmpty():
        pieces = connected_components(scratch, cut.select(F.col("cls").alias("a"), F.col("label").alias("b")), "pieces")
        known = known.union(pieces.select("id", "component"))
    label = reps.select("id", "s1", "s2", "n", "cls").join(known, "cls", "left").select("id", "s1", "s2", "n", F.coalesce("label", "cls").alias("label"))
    label = scratch.write(label, "label")
    # Ids whose rows hold several texts.
    several = sets.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi").select("id")
    several = scratch.write(several, "several")
    if several.isEmpty():
        return label
    shared = scratch.write(sets.join(several, "id").join(label.drop("id"), ["s1", "s2", "n"]).select("id", "label").distinct(), "shared")
    edges = shared.join(shared.groupBy("id").agg(F.min("label").alias("b")), "id").select(F.col("label").alias("a"), "b")
    merged = connected_components(scratch, edges, "merged").select(F.col("id").alias("label"), "component")
    return scratch.write(label.join(merged, "label", "left").select("id", "s1", "s2", "n", F.coalesce("component", "label").alias("label")), "merged")
