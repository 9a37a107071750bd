"""Exact repeats across documents, by longest-previous-factor arrays over the suffixes that can repeat.

A byte goes if a string of min_bytes bytes that covers it also starts in a document with a smaller id.

1. Contexts.  Every window of min_bytes bytes chooses the least hash among its k-grams (the leftmost, if several tie), its
   anchor, so equal windows choose equal anchors at equal places.  Windows that follow each other with one anchor form a
   context.  Documents are dealt into slices; a slice sends each context that it holds once, as a fingerprint (64 bits of
   the anchor, 64 of the context) with its smallest document, to the part that its anchor names: a passage that stands in
   every document is one entry a slice.
2. Answers.  A part tells the slices where an equal context has an earlier document, which is all that a copied passage
   needs.  Where one anchor has several contexts of different documents, it asks the earliest document of each for the bytes.
3. Suffixes.  The bytes of those contexts meet in the part of their anchor and are put in suffix order.  Neighbours give the
   longest common prefixes; the previous and the next suffix of an earlier document give the longest previous factor of
   each suffix (counted up to min_bytes: longer ones change nothing).  A window whose factor has min_bytes bytes is a repeat.
4. Documents drop the bytes that answers and suffixes cover.

What travels is packed in binary rows, one per slice and part; slices hold about part_bytes of text, however large the
corpus.  Contexts of one anchor are told apart by 64 bits; all else is compared byte by byte.

Texts are their UTF-8 bytes (null: empty).  Matches never cross documents; strings are judged on the input.

Defined results: rows that repeat an id are documents of one id, which never match each other; a null id takes no part
(nothing is removed from it or because of it); an empty table gives no rows; columns named in ``keep`` come through whatever
their names, except those named like the ones added, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, Scratch, mix, text_slices

GRAM = 20
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>, kept_text string"


def contexts(data: np.ndarray, offs: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, document, first window, windows) of all contexts; windows count from the document's start."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    if len(data) < min_bytes:
        return none
    prefix = PrefixHash(data)
    h = prefix.grams(gram)
    bits = np.uint64(int(len(h)).bit_length())
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span, wide = 1, min_bytes - gram + 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if wide > span:
        key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    lens = np.diff(offs)
    doc = np.repeat(np.arange(len(lens)), lens)[: len(key)]
    good = np.arange(len(key)) + min_bytes <= offs[doc + 1]
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    p = np.flatnonzero(good)
    if not len(p):
        return none
    a = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p)))
    start = p[first]
    return h[a[first]], prefix(start, start + n + min_bytes - 1), doc[start], (start - offs[doc[start]]).astype(np.int32), n.astype(np.int32)


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of rows of bytes: sorted rows, and each one's common prefix with the row before (0 for the first)."""
    n, m = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{m}").reshape(-1), kind="stable") if n else np.zeros(0, np.int64)
    s = windows[order]
    differs = s[1:] != s[:-1]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = np.where(differs.any(1), differs.argmax(1), m)
    return order, lcp


def previous_factors(lcp: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """In suffix order: the longest common prefix of each suffix with one of a smaller rank.

    That is the greater of those with the previous and the next smaller rank, and the prefix shared with either is the least
    lcp on the way.  Each suffix follows the pointers of those that it meets, so ways double from round to round.
    """

    def towards(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
        """common[i]: prefix that i shares with i - 1 (0 for the first)."""
        at, best = np.arange(len(rank)) - 1, common.copy()
        todo = np.flatnonzero((at >= 0) & (rank[at] >= rank))
        while len(todo):
            via = at[todo]
            best[todo], at[todo] = np.minimum(best[todo], best[via]), at[via]
            todo = todo[(at[todo] >= 0) & (rank[at[todo]] >= rank[todo])]
        best[at < 0] = 0
        return best

    after = np.append(lcp[1:], 0)
    return np.maximum(towards(rank, lcp), towards(rank[::-1], after[::-1])[::-1])


def _find(keys: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each pair of asked its place among the distinct pairs of keys, or -1."""
    with np.errstate(over="ignore"):
        k, q = (mix(x ^ (y * np.uint64(0x9E3779B97F4A7C15))) for x, y in (keys, asked))
    order = np.argsort(k, kind="stable")
    k, at, out = k[order], np.searchsorted(k[order], q), np.full(len(q), -1)
    todo = np.flatnonzero(at < len(k))
    while len(todo):
        todo = todo[k[at[todo]] == q[todo]]
        place = order[at[todo]]
        hit = (keys[0][place] == asked[0][todo]) & (keys[1][place] == asked[1][todo])
        out[todo[hit]] = place[hit]
        todo = todo[~hit]
        at[todo] += 1
        todo = todo[at[todo] < len(k)]
    return out


def _classes(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each pair, a row of each class)."""
    with np.errstate(over="ignore"):
        k = mix(h ^ (c * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(k)
    same = k[order][1:] == k[order][:-1]
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    if (same & new[1:]).any():  # two pairs of one key may lie mixed
        order = np.lexsort((c, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    cls = np.empty(len(h), np.int64)
    cls[order] = np.cumsum(new) - 1
    return cls, order[new]


def _runs(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans (row, a, b) with those that meet or overlap joined."""
    order = np.lexsort((a, rows))
    rows, a, b = rows[order], a[order], b[order]
    new = np.ones(len(rows), bool)
    wide = np.int64(b.max(initial=0) + 1)
    start = np.cumsum(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    end = np.maximum.accumulate(b + start * wide) - start * wide  # within a row, as rows are far apart
    new[1:] = (rows[1:] != rows[:-1]) | (a[1:] > end[:-1])
    first = np.flatnonzero(new)
    return rows[first], a[first], end[np.append(first[1:], len(rows)) - 1] if len(rows) else end


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed row. Bytes of texts and columns of counters shrink; hashes do not."""
    import zstandard

    raw = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    out, at, blob = [], 0, zstandard.ZstdDecompressor().decompress(blob)
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _by(target: np.ndarray):
    """(value, positions) of each distinct value."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    t = target[order]
    cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(t)), strict=True):
        yield int(t[a]), order[a:b]


def _rows(keys: list[int], blobs: list[bytes], whole: list[bool] | None = None):
    import pyarrow as pa

    cols = [pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())] + ([] if whole is None else [pa.array(whole, pa.bool_())])
    return pa.RecordBatch.from_arrays(cols, names=["part", "blob", "whole"][: len(cols)])


def _table(batch):
    import pyarrow as pa

    return pa.Table.from_batches([batch])


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def remove_repeats(scratch: Scratch, docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, part_bytes: int = 8 << 20) -> DataFrame:
    """docs (id, or the columns of ``keep``) with n_bytes, n_removed, n_spans, kept_sha256, spans and kept_text.

    kept_text is what is left as text: of a character that is removed in part, no byte stays.
    """
    gram, wide = min(GRAM, max(1, min_bytes // 2)), min_bytes - 1
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(max(48, -(-total // part_bytes)))
    # _row names a document and its text; equal rows have equal results. The slice follows from it.
    row = F.xxhash64(doc, text)
    texts = docs.where(doc.isNotNull()).select(doc.alias("_doc"), row.alias("_row"), text.alias("_text"), F.pmod(row, F.lit(parts)).cast("int").alias("_part"))
    packed = "part int, blob binary"

    def entries(table):
        """(document ids, row names, bytes, offsets, contexts) of the distinct rows of a slice, a piece at a time."""
        seen: set[int] = set()
        for batch in table.combine_chunks().to_batches():
            ids, names = batch.column("_doc").to_numpy(), batch.column("_row").to_numpy()
            for rows, data, offs in text_slices(batch, batch.schema.get_field_index("_text")):
                fresh = np.array([n not in seen and not seen.add(n) for n in names[rows].tolist()], bool)
                found = contexts(data, offs, min_bytes, gram)
                if not fresh.all():
                    found = tuple(x[fresh[found[2]]] for x in found)
                yield ids[rows], names[rows], data, offs, found

    def sent(table):
        """Each context of a slice once, with its smallest document."""
        h, c, ids = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64))
        for own, _, _, _, (anchor, hashed, d, _, _) in entries(table):
            h.append(anchor), c.append(hashed), ids.append(own[d])
        h, c, ids = np.concatenate(h), np.concatenate(c), np.concatenate(ids)
        cls, some = _classes(h, c)
        low = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(low, cls, ids)
        h, c, source = h[some], c[some], table.column("_part")[0].as_py()
        keys, blobs = [], []
        for part, at in _by((h % np.uint64(parts)).astype(np.int64)):
            keys.append(part)
            blobs.append(_pack(np.array([source], np.int32), h[at], c[at], low[at]))
        return _rows(keys, blobs)

    def answers(group):
        """To slices: contexts with an earlier document elsewhere, and those whose bytes are asked for."""
        cols = [[], [], [], []]
        for blob in group.column("blob"):
            source, h, c, low = _unpack(blob.as_py(), ("<i4", "<u8", "<u8", "<i8"))
            for z, x in zip(cols, (np.repeat(source, len(h)), h, c, low), strict=True):
                z.append(x)
        source, h, c, low = (np.concatenate(z) for z in cols)
        del cols
        order = np.lexsort((low, c, h))
        source, h, c, low = (x[order] for x in (source, h, c, low))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        cls, anchor = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
        first = low[new_c]  # of each class: rows are sorted by it
        begin = np.flatnonzero(new_h)
        lo, hi = np.minimum.reduceat(low, begin), np.maximum.reduceat(first[cls], begin)
        asked = (lo[anchor] < hi[anchor]) & (low == first[cls])
        at = np.flatnonzero(asked | (low > first[cls]))
        keys, blobs = [], []
        for part, rows in _by(source[at]):
            rows = at[rows]
            keys.append(part)
            blobs.append(_pack(h[rows], c[rows], first[cls[rows]], asked[rows].astype(np.uint8)))
        return _rows(keys, blobs)

    answered = texts.groupBy("_part").applyInArrow(lambda t: _table(sent(t)), packed).groupBy("part").applyInArrow(lambda t: _table(answers(t)), packed)
    answered = scratch.write(answered, "answers")

    def applied(left, right):
        """Spans of a slice's documents that answers cover (whole), and the contexts asked for, to their parts."""
        cols = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.uint8)]
        for blob in right.column("blob"):
            for z, x in zip(cols, _unpack(blob.as_py(), ("<u8", "<u8", "<i8", "<u1")), strict=True):
                z.append(x)
        known_h, known_c, known_low, known_asked = (np.concatenate(z) for z in cols)
        pieces = list(entries(left)) if left.num_rows else []
        if not pieces:
            return _rows([], [], [])
        source = left.column("_part")[0].as_py()
        h, c = np.concatenate([x[4][0] for x in pieces]), np.concatenate([x[4][1] for x in pieces])
        ids, names = (np.concatenate([x[k][x[4][2]] for x in pieces]) for k in (0, 1))
        p, n = (np.concatenate([x[4][k] for x in pieces]) for k in (3, 4))
        cls, some = _classes(h, c)
        low, asked = np.full(len(some), np.iinfo(np.int64).max), np.zeros(len(some), bool)
        np.minimum.at(low, cls, ids)
        at = _find((known_h, known_c), (h[some], c[some])) if len(known_h) else np.full(len(some), -1)
        hit = at >= 0
        asked[hit] = known_asked[at[hit]] > 0
        low[hit] = np.minimum(low[hit], known_low[at[hit]])
        later = ids > low[cls]
        keys, blobs, whole = [], [], []
        if later.any():
            keys.append(source)
            blobs.append(_pack(*_runs(names[later], p[later].astype(np.int64), p[later].astype(np.int64) + n[later] + wide)))
            whole.append(True)
        wanted = np.flatnonzero(asked[cls] & (ids == low[cls]))
        starts = np.cumsum([0, *(len(x[4][0]) for x in pieces)])
        piece = np.searchsorted(starts, wanted, side="right") - 1
        for part, rows in _by((h[wanted] % np.uint64(parts)).astype(np.int64)):
            row, of = wanted[rows], piece[rows]
            raw = []
            for k in np.unique(of).tolist():
                _, _, data, offs, (_, _, d, start, count) = pieces[k]
                own = row[of == k] - starts[k]
                raw.append(data[_ranges(offs[d[own]] + start[own], count[own] + wide)])
            keys.append(part)
            blobs.append(_pack(np.array([source], np.int32), h[row], c[row], ids[row], names[row], p[row], n[row], np.concatenate(raw)))
            whole.append(False)
        return _rows(keys, blobs, whole)

    spread = texts.groupBy("_part").cogroup(answered.groupBy("part")).applyInArrow(lambda a, b: _table(applied(a, b)), packed + ", whole boolean")
    spread = scratch.write(spread, "spread")
    scratch.drop("answers")

    def factors(group):
        """The repeats that suffix order tells, to the slices of their documents."""
        cols, raws = [[] for _ in range(7)], []
        for blob in group.column("blob"):
            source, *rest, raw = _unpack(blob.as_py(), ("<i4", "<u8", "<u8", "<i8", "<i8", "<i4", "<i4", "<u1"))
            for z, x in zip(cols, (np.repeat(source, len(rest[0])), *rest), strict=True):
                z.append(x)
            raws.append(raw)
        source, h, c, ids, names, p, n = (np.concatenate(z) for z in cols)
        p, n = p.astype(np.int64), n.astype(np.int64)
        raw, ends = np.concatenate(raws), np.cumsum(n + wide)
        cls, some = _classes(h, c)  # owners of one context send it each
        starts = ends[some] - n[some] - wide
        count = n[some]
        windows = np.lib.stride_tricks.sliding_window_view(raw, min_bytes)[_ranges(starts, count)]
        owner = np.repeat(np.arange(len(some)), count)
        order, lcp = suffix_order(windows)
        hit = np.zeros(len(owner), bool)
        hit[order] = previous_factors(lcp, ids[some][owner[order]]) >= min_bytes
        begin = np.cumsum(count) - count
        # Every document that owns a context drops the context's hits.
        at = np.flatnonzero(np.bincount(owner[hit], minlength=len(some))[cls] > 0)
        window = _ranges(begin[cls[at]], n[at])
        entry = np.repeat(at, n[at])
        place = (_ranges(np.zeros(len(at), np.int64), n[at]) + np.repeat(p[at], n[at]))[hit[window]]
        entry = entry[hit[window]]
        keys, blobs = [], []
        for part, rows in _by(source[entry]):
            keys.append(part)
            blobs.append(_pack(*_runs(names[entry[rows]], place[rows], place[rows] + min_bytes)))
        return _rows(keys, blobs)

    more = spread.where("not whole").select("part", "blob").groupBy("part").applyInArrow(lambda t: _table(factors(t)), packed)
    cuts = scratch.write(spread.where("whole").select("part", "blob").unionByName(more), "cuts")
    scratch.drop("spread")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    kept_cols = [c for c in dict.fromkeys(keep or [id_col]) if c not in new]
    inner = [f"_k{i}" for i in range(len(kept_cols))]
    full = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept_cols, inner, strict=True)], row.alias("_row"), text.alias("_text"), F.pmod(row, F.lit(parts)).cast("int").alias("_part"))

    def cut_out(left, right):
        import pyarrow as pa

        cols_ = [[np.zeros(0, np.int64)] for _ in range(3)]
        for blob in right.column("blob"):
            for z, x in zip(cols_, _unpack(blob.as_py(), ("<i8",) * 3), strict=True):
                z.append(x)
        names, a, b = _runs(*(np.concatenate(z) for z in cols_))
        row_names, cols = left.column("_row").to_numpy(), {c: [] for c in new}
        lo, hi = np.searchsorted(names, row_names).tolist(), np.searchsorted(names, row_names, side="right").tolist()
        for i, j, t in zip(lo, hi, left.column("_text"), strict=True):
            raw = (t.as_py() or "").encode()
            spans = list(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True))
            left_over = b"".join(raw[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)) if spans else raw
            cols["n_bytes"].append(len(raw))
            cols["n_removed"].append(len(raw) - len(left_over))
            cols["n_spans"].append(len(spans))
            cols["kept_sha256"].append(hashlib.sha256(left_over).hexdigest())
            cols["spans"].append([{"begin": s, "end": e} for s, e in spans])
            cols["kept_text"].append(_whole_characters(raw, spans) if spans else raw.decode())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.Table.from_arrays([*(left.column(c) for c in inner), *(pa.array(cols[c], k) for c, k in zip(new, kinds, strict=True))], names=[*inner, *new])

    schema = ", ".join(f"{i} {full.schema[i].dataType.simpleString()}" for i in inner) + ", " + RESULT
    done = full.groupBy("_part").cogroup(cuts.groupBy("part")).applyInArrow(lambda a, b: cut_out(a, b), schema)
    return done.select(*[F.col(i).alias(c) for c, i in zip(kept_cols, inner, strict=True)], *new)


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in [*spans, (len(raw), len(raw))]:
        piece = raw[at:s]
        while piece and piece[0] & 0xC0 == 0x80:
            piece = piece[1:]
        out.append(piece.decode(errors="ignore"))
        at = e
    return "".join(out)
