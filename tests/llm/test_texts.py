"""Operators on documents against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import mixing, packing, token_file
from vellum.llm.minhash import chunk_keys, chunk_plan, linked_pairs, near_duplicates, shingle_hashes, signatures, threshold_of
from vellum.llm.quality import N_META, N_TEXT, CoTrained, _matrix, _surest, classify
from vellum.llm.suffix import _find, _runs, previous_factors, remove_repeats, suffix_order
from vellum.llm.tokens import Encoder, default_path

from .brute import word_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, block int, key int, kept int"


def odd_documents(spark, extra=()):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(300)]
    long = " ".join(rng.choice(words, 60_000))
    base = " ".join(rng.choice(words, 120))
    near = base.rsplit(" ", 2)[0] + " new ending"
    rows = [(0, base), (1, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t"), (6, "one two"), (7, "ONE two"), (8, long), (9, long[:3000] + base), (None, base), (10, "é" * 60 + base[:70]), (11, "xé" * 60 + base[:70]), *extra]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (3, None) else f"src{i % 3}", None if t is None else len(t), "p", 1, 2, 3) for i, t in rows], DOCS)


ODD = ["", "don't I'LL x!'s <|endoftext|> y", "naïve ŒUVRE Σίσυφος", "a\x85b\xa0c\x1fd", "ÀÉÎ ½ ² 12 µ ª", "日本語 text", "á b", "\x00 a\x00b", "ab\xadcd", "İ I", "a" * 3000]


def whole(text):
    return np.array(Encoder.get(default_path()).full.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_are_encoded_like_the_library(text):
    assert Encoder.get(default_path()).encode_bytes(text) == whole(text)


@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text_is_encoded_like_the_library(text):
    assert Encoder.get(default_path()).encode_bytes(text) == whole(text)


def test_the_cache_is_bounded(monkeypatch):
    from vellum.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 10)
    e = Encoder(default_path())
    for i in range(100):
        assert e.encode_bytes(f"w{i} again") == whole(f"w{i} again")
    assert len(e.words) <= 11


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_come_back(mode):
    for n in (0, 1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (token_file.from_planes(token_file.to_planes(ids, mode, 3), n) == ids).all()


@given(st.lists(st.binary(max_size=12).map(lambda b: b[: len(b) // 4 * 4]), min_size=1, max_size=6))
def test_crc_of_parts(parts):
    assert token_file.crc_of_parts([len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("block, mode", [(64, "byte"), (1 << 16, "bit")])
def test_token_files(spark, scratch, block, mode):
    docs = odd_documents(spark)
    path = scratch.path(f"tokens-{block}")
    token_file.write_token_files(docs, path, "doc_id", "text", default_path(), 2, block, mode)
    got = token_file.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    have = sorted((r["doc_id"], bytes(r["ids"])) for r in got if r["doc_id"] is not None)
    assert have == sorted((r["doc_id"], whole(r["text"]) + b"\2\0\0\0") for r in docs.collect() if r["doc_id"] is not None)


def test_no_documents(spark, scratch):
    none = odd_documents(spark).limit(0)
    token_file.write_token_files(none, scratch.path("none"), "doc_id", "text", default_path())
    assert token_file.read_documents(spark, scratch.path("none")).count() == 0
    assert packing.pack(scratch, packing.token_pieces(none, "doc_id", "text", default_path())).count() == 0
    assert near_duplicates(scratch, none).count() == 0
    assert remove_repeats(scratch, none).count() == 0
    assert mixing.mix(scratch, none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(scratch, none, labels).count() == 0


#: Names that an operator uses inside, or returns.
INNER = "_s _t _id _row _doc _text _part _b _n _in _len _h _before _all _rank _lo _hi _base _at _o _raw _j _k _f _salt length n cls grp label key m a b q view held phase chars part blob whole component rep set".split()


def test_columns_of_any_name_come_through_or_are_not_read(spark, scratch):
    plain = odd_documents(spark).drop("part", "block", "key", "kept").where("doc_id is null or doc_id not in (8, 9)")
    own = plain.withColumns({c: F.lit("own") for c in INNER if c not in plain.columns})
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (6, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")

    def result(out, cols):
        return sorted(map(repr, out.select(*cols).collect()))

    for apply, cols in (
        (lambda d: remove_repeats(scratch, d, keep=d.columns), ["doc_id", "n_removed", "kept_sha256"]),
        (lambda d: mixing.mix(scratch, d, block_chars=400), ["doc_id", "block", "slot", "at_char"]),
        (lambda d: classify(scratch, d, labels), ["doc_id", "p_text", "p_meta", "p_quality", "kept"]),
        (lambda d: packing.pack(scratch, packing.token_pieces(d, "doc_id", "text", default_path(), keep=tuple(c for c in INNER if c in d.columns and c not in ("length",)))), ["doc_id", "piece", "length"]),
    ):
        out = apply(own)
        assert result(apply(plain), cols) == result(out, cols)
        for c in set(INNER) & set(out.columns) - set(cols):
            assert {r[0] for r in out.select(f"`{c}`").distinct().collect()} == {"own"}


def test_whole_table_of_token_files_and_pieces(spark, sf_dir):
    """Every document's ids against the library, through the queries."""
    from vellum.llm.queries import op5_token_file, op10_packing

    texts = {r["doc_id"]: whole(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    at = 0
    for r in op5_token_file(spark, sf_dir).orderBy("doc_id").collect():
        ids = texts[r["doc_id"]] + b"\2\0\0\0"
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    packed = op10_packing(spark, sf_dir).collect()
    have = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed}
    want = {(d, k // 8192): (k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])) for d, t in texts.items() for ids in [t + bytes(4)] for k in range(0, len(ids), 8192)}
    assert have == want and len(packed) == len(want)
    total = sum(r["length"] for r in packed)
    assert check_packing(packed, 2048) <= -(-total // 2048) * 1.02 + 1


def check_packing(rows, max_len):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= max_len
    return len(by)


def test_packing(spark, scratch):
    docs = odd_documents(spark)
    rows = packing.pack(scratch, packing.token_pieces(docs, "doc_id", "text", default_path(), with_ids=True)).collect()
    n = check_packing(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert -(-total // 2048) <= n <= -(-total // 2048) + 1 and len({r["doc_id"] for r in rows}) == docs.select("doc_id").distinct().count()
    for d in (0, 3, 8):
        parts = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        ids = b"".join(bytes(r["ids"]) for r in parts)
        text = docs.where(F.col("doc_id") == d).first()["text"]
        assert ids == whole(text) + bytes(4) and all(r["length"] == 2048 for r in parts[:-1]) and [r["start"] for r in parts] == [2048 * i for i in range(len(parts))]
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in parts)


def best_fit(lengths, max_len):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i < len(rooms):
            space = rooms.pop(i)
        else:
            space, n = max_len, n + 1
        bisect.insort(rooms, space - x)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_plan_against_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), np.minimum(2048, rng.lognormal(5.5, 1, 5000).astype(int) + 1), rng.choice([700, 683, 1365, 2048, 3], 999), np.full(100, 1024)][seed].tolist()
    runs = packing.plan({k: lengths.count(k) for k in set(lengths)}, 2048)
    rows = [{"sequence_id": base + i, "offset": at, "length": k} for k, lo, hi, base, at in runs for i in range(hi - lo)]
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_packing(rows, 2048) <= best_fit(lengths, 2048) * 1.01 + 1


def brute_repeats(rows, m):
    first = {}
    for i, b in sorted(rows, key=lambda r: r[0]):
        for p in range(len(b) - m + 1):
            first.setdefault(b[p : p + m], i)
    out = []
    for i, b in rows:
        cover = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if first[b[p : p + m]] < i:
                cover[p : p + m] = b"\1" * m
        runs = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return sorted(out)


def test_suffix_dedup_on_odd_documents(spark, scratch):
    docs = odd_documents(spark)
    cut = remove_repeats(scratch, docs, keep=docs.columns)
    assert cut.columns[: len(docs.columns)] == docs.columns
    got = cut.collect()
    known = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None)
    assert known == brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect() if r["doc_id"] is not None], 50)
    lone = next(r for r in got if r["doc_id"] is None)
    assert lone["n_removed"] == 0 and lone["kept_text"] == lone["text"]


@given(st.lists(st.text(alphabet="ab", max_size=40), max_size=6))
@settings(max_examples=15, deadline=None)
def test_suffix_dedup_on_small_alphabets(spark, texts):
    from vellum.llm.common import Scratch

    s = Scratch(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = remove_repeats(s, docs, min_bytes=8).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 8)
    s.clear()


@given(st.lists(st.tuples(st.text(alphabet="ab", min_size=5, max_size=5), st.integers(0, 4)), max_size=25))
def test_previous_factors_in_suffix_order(rows):
    w = np.array([list(t.encode()) for t, _ in rows], np.uint8).reshape(-1, 5)
    rank = np.array([r for _, r in rows], np.int64)
    order, lcp = suffix_order(w)
    got = np.zeros(len(rows), np.int64)
    got[order] = previous_factors(lcp, rank[order])
    common = lambda t, u: next((k for k in range(5) if t[k] != u[k]), 5)
    assert got.tolist() == [max([common(t, u) for u, s in rows if s < r], default=0) for t, r in rows]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(1, 6)), max_size=20))
def test_runs(spans):
    rows, a, n = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ([], [], [])))
    got = {(r, k) for r, x, y in zip(*(v.tolist() for v in _runs(rows, a, a + n)), strict=True) for k in range(x, y)}
    assert got == {(r, k) for r, x, m in spans for k in range(x, x + m)}


def test_pairs_are_found_among_pairs():
    rng = np.random.default_rng(1)
    h, c = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(0, 40, 300).astype(np.uint64)
    keys = np.unique(np.stack([h, c], axis=1), axis=0)
    at = _find((keys[:, 0], keys[:, 1]), (h, c))
    assert (keys[at] == np.stack([h, c], axis=1)).all() and (_find((keys[:5, 0], keys[:5, 1]), (keys[5:, 0], keys[5:, 1])) == -1).all()


@pytest.mark.parametrize("part_bytes", [12 << 20, 2000])
def test_suffix_dedup_of_many_copies(spark, scratch, part_bytes):
    """A passage in every document, copies with changes and repeated rows over many slices, against brute force."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcd "), rng.integers(2, 7))) for _ in range(40)]
    line = "this very line stands in each of the documents that there are, word by word"
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    rows = []
    for i in range(150):
        t = base[i % 6]
        cut = int(rng.integers(len(t)))
        rows.append((int(rng.integers(0, 120)), t[:cut] + "#" * int(rng.integers(0, 3)) + t[cut:] + line + "".join(rng.choice(words, 3))))
    rows += rows[:5]
    got = remove_repeats(scratch, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), part_bytes=part_bytes).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats([(i, t.encode()) for i, t in rows], 50)


def brute_near(rows, num, den, components):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(word_set(t or "", 5))
    flat = [(i, s) for i, own in sets.items() for s in own]
    edges = [(a, b) for a, s in flat for b, t in flat if a < b and s and t and den * len(s & t) >= num * len(s | t)]
    return components(list(sets), edges)


def test_minhash_on_odd_documents(spark, scratch, components):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    extra, doc = [], 100
    for _ in range(12):  # chains of small changes: links beyond the smallest of a key
        t = list(rng.choice(words, 80))
        for _ in range(8):
            extra.append((doc, " ".join(t)))
            doc += 1
            t[int(rng.integers(80))] = "changed"
    docs = odd_documents(spark, extra)
    got = near_duplicates(scratch, docs).collect()
    assert len(got) == docs.count()
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 85, 100, components)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None) and next(r for r in got if r["doc_id"] is None)["kept"]
    assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 0


@pytest.mark.parametrize("sizes", [{}, {"block": 7}, {"block_bytes": 4000}])
def test_a_group_just_below_the_similarity(spark, scratch, components, sizes):
    """Members of one group that are close by signature, of which few are linked; blocks cut the group."""
    rng = np.random.default_rng(5)
    base, rows = [f"b{i}" for i in range(100)], []
    for i in range(40):
        t = list(base)
        for j in rng.choice(100, int(rng.integers(1, 4)), replace=False):
            t[int(j)] = f"x{i % 20}"
        rows.append((i, " ".join(t)))
    rows += [(7, "another text of id seven"), (50, "another text of id seven"), (51, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(scratch, docs, **sizes).collect()
    want = brute_near(rows, 85, 100, components)
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert 1 < len(set(want.values())) < len(want)


@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=30), st.integers(0, 30))
@settings(deadline=None)
def test_pairs_are_linked_by_their_sets(sets, cut):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = np.array([[2 * len(a & b) >= len(a | b) for b in sets] for a in sets])
    got = linked_pairs(arrays, None, 1, 2, chunk=4)
    assert ((got == want) | np.eye(len(sets), dtype=bool)).all()  # a set and itself are nobody's pair
    if 0 < cut < len(sets):
        assert (linked_pairs(arrays[:cut], arrays[cut:], 1, 2, chunk=4) == want[:cut, cut:]).all()


def test_pigeonhole_and_threshold():
    t = threshold_of(96, 0.85)
    plan = chunk_plan(96, t, 1)
    assert sum(e + 1 for _, e in plan) > t and [i for r, _ in plan for i in r] == list(range(96))
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (1, 96)).astype(np.uint16)
    for _ in range(50):
        other = sig.copy()
        other[0, rng.choice(96, t, replace=False)] ^= 1
        assert (chunk_keys(sig, plan) == chunk_keys(other, plan)).any()


def test_signatures_estimate_similarity():
    def sig(words):
        b = np.frombuffer(" ".join(words).encode(), np.uint8)
        d, s = shingle_hashes(b, np.array([0, len(b)]), 5)
        return signatures(d, s, 1, 512, 3)[0], len(s)

    words = [f"v{i}" for i in range(400)]
    (a, n), (b, m) = sig(words), sig(words[:360])
    assert (n, m) == (396, 356) and abs((a == b).mean() - 356 / 396) < 0.06


@given(st.lists(st.text(alphabet="aB \n\té", max_size=30), max_size=5))
@settings(deadline=None)
def test_shingles_are_those_of_the_words(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    d, _ = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), offs, 5)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(word_set(t, 5)) for t in texts] or not texts


def edf(shares):
    """The earliest-deadline-first schedule by simulation."""
    q, done, out = sum(a for _, a in shares), [0] * len(shares), []
    for t in range(q):
        ready = [(-(-(n + 1) * q // a), int((n + 1) * q % a == 0), -a, i) for i, (n, (_, a)) in enumerate(zip(done, shares, strict=True)) if n * q // a <= t]
        due, _, _, i = min(ready)
        assert due > t
        out.append((shares[i][0], done[i], t))
        done[i] += 1
    return out


@pytest.mark.parametrize("shares", [[("a", 1)], [("a", 7), ("b", 3)], [("a", 5), ("b", 1), ("c", 1)], [(str(i), 1 + i * i) for i in range(9)]])
def test_frame_is_pfair(spark, shares):
    df = spark.createDataFrame([([{"source": s, "a": a} for s, a in shares],)], "shares array<struct<source:string,a:int>>")
    got = [(x["source"], x["k"], x["slot"]) for x in df.select(mixing.frame_slots(F.col("shares"))).first()[0]]
    assert got == edf(shares)
    q, done = sum(a for _, a in shares), {s: 0 for s, _ in shares}
    for s, _, t in got:
        done[s] += 1
        assert all(abs(done[x] - a * (t + 1) / q) < 1 for x, a in shares)


def brute_mixture(rows, weights, block_chars, frame):
    """slot of every place (source, at_char) by simulation of all phases and frames. rows: (source, at_char, size)."""
    import math

    chars = {}
    for s, at, size in rows:
        chars[s] = max(chars.get(s, 0), at + size)
    live = sorted((chars[s] / w, s) for s, w in weights.items() if s in chars)
    out, slot0, block0, shares = {}, 0, dict.fromkeys(chars, 0), []
    for p, (to_t, _) in enumerate(live):
        from_t = live[p - 1][0] if p else 0.0
        cut = lambda s, t: min(math.floor(weights[s] * t), chars[s])
        spans = [(s, cut(s, from_t), chars[s] if e <= to_t else cut(s, to_t)) for e, s in live[p:]]
        spans = [(s, a, b - a) for s, a, b in spans if b > a]
        total = sum(n for _, _, n in spans)
        if not total:
            continue
        slots = -(-total // block_chars)
        a = {s: max(1, math.floor(min(slots, frame) * n / total + 0.5)) if len(spans) > 1 else 1 for s, _, n in spans}
        q = sum(a.values())
        frames = max(1, math.floor(slots / q + 0.5))
        at = {(s, k): t for s, k, t in edf(sorted(a.items()))}
        for s, first, n in spans:
            for r, place, _ in rows:
                if r == s and first <= place < first + n:
                    j = min(math.floor((place - first) / n * (a[s] * frames)), a[s] * frames - 1)
                    out[s, place] = (block0[s] + j, slot0 + j // a[s] * q + at[s, j % a[s]])
            block0[s] += a[s] * frames
        shares.append((slot0, slot0 + q * frames, {s: (first, n) for s, first, n in spans}, total))
        slot0 += q * frames
    return out, shares


@pytest.mark.parametrize("sizes, block_chars, frame", [((600, 300, 100), 500, 1000), ((900, 50, 7), 300, 10), ((30, 30, 30), 40, 7)])
def test_mixing_against_a_simulation(spark, scratch, sizes, block_chars, frame):
    rng = np.random.default_rng(9)
    rows = [(1000 * i + j, f"src{i}", "x" * int(rng.integers(0, 120))) for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    weights = {"src0": 5.0, "src1": 3.0, "src2": 2.0}
    got = mixing.mix(scratch, docs, block_chars=block_chars, frame=frame, weights=weights).collect()
    assert len(got) == len(rows)
    places = [(r["source"], r["at_char"], len(r["text"]) + 1) for r in got]
    want, shares = brute_mixture(places, weights, block_chars, frame)
    assert {(r["source"], r["at_char"]): (r["block"], r["slot"]) for r in got} == want
    # At the end of every slot each source has delivered its share of the phase's characters, but for less than one block.
    for lo, hi, spans, _ in shares:
        for s, (first, n) in spans.items():
            own = sorted((slot, place) for (r, place), (_, slot) in want.items() if r == s and lo <= slot < hi)
            block = n / max(1, len({b for (r, _), (b, slot) in want.items() if r == s and lo <= slot < hi}))
            for slot, place in own:
                assert abs((place - first) - n * (slot - lo) / (hi - lo)) < 2 * block  # one block, and the place within it


def test_three_equal_sources_stay_within_a_block(spark):
    n = 10_000 * 65_536
    parts = mixing.phases(spark.createDataFrame([(s, 1.0, n) for s in "abc"], "source string, w double, chars long"), 65_536)
    (r,) = parts.groupBy("phase", "q", "frames").agg(F.array_sort(F.collect_list(F.struct("source", "a", "n_chars"))).alias("shares")).collect()
    assert {x["source"]: x["n_chars"] for x in r["shares"]} == dict.fromkeys("abc", n)
    order, done = edf([(x["source"], x["a"]) for x in r["shares"]]), dict.fromkeys("abc", 0)
    assert 29_000 < len(order) * r["frames"] < 31_000
    for t in range(len(order) * r["frames"]):
        done[order[t % len(order)][0]] += 1
        assert all(abs(done[x] - (t + 1) / 3) < 1 for x in done)


def test_mixing_of_odd_documents(spark, scratch):
    docs = odd_documents(spark).withColumns({c: F.lit("own") for c in ("_s", "_t", "_id", "_row", "phase", "a", "_k")})
    mixed = mixing.mix(scratch, docs, block_chars=500, weights={"src0": 5, "src1": 3, "src2": 0})
    got = mixed.collect()
    assert len(got) == docs.count() and set(docs.columns) <= set(mixed.columns)
    assert all(r[c] == "own" for r in got for c in ("_s", "_t", "_id", "_row", "phase", "a", "_k"))
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[t]))[0] for t in sorted(slots)]
    unweighted = [s for s in order if s in (None, "src2")]
    assert order[-len(unweighted) :] == unweighted == sorted(unweighted, key=lambda s: "-" if s is None else f"s{s}")


def test_mixing_is_native(spark, sf_dir):
    from vellum.llm.queries import op3_mixing

    plan = op3_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality(spark, scratch, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    out = classify(scratch, docs, train).join(held, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] > 0) for r in out]) >= 0.95


def two_view_documents(n=1500, seed=2):
    """Texts of which half tell, and sources of which half tell, independently of each other."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = bool(rng.random() < 0.6)
        told = rng.random(2) < 0.6
        words = rng.choice(["lorem", "ipsum", "dolor", "amet"] + (["sound", "plain"] if good else ["zzzq", "wxyk"]) * (3 * told[0]), 30)
        source = f"{'a' if good else 'b'}{rng.integers(4)}" if told[1] else f"n{rng.integers(4)}"
        rows.append((i, " ".join(words), "en", source, 100, int(good)))
    return rows


def test_views_teach_each_other(spark, scratch):
    rows = two_view_documents()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows[:120]], "doc_id long, quality int, toxic int")
    share = {}
    for rounds in (0, 3):
        out = {r["doc_id"]: r for r in classify(scratch, docs, labels, rounds=rounds).collect()}
        share[rounds] = [np.mean([(out[r[0]][c] >= 0.5) == (r[5] > 0) for r in rows[120:]]) for c in ("p_text", "p_meta", "p_quality")]
    assert share[3][2] >= share[0][2] - 0.005 and share[3][2] > max(share[3][:2]) and share[3][2] >= 0.85
    pooled = scratch.write(spark.createDataFrame([(i, bytes(2 * (N_TEXT + N_META - 1)) + np.float16(i % 97).tobytes()) for i in range(500)], "h long, f binary").repartition(7), "pool")
    model = CoTrained(np.random.default_rng(0).standard_normal((40, N_TEXT + N_META)), np.arange(40) % 2.0, np.arange(40) % 4 == 3)
    found = _surest(pooled, model, 20, 0.0)
    p = model.scores(_matrix(pooled.select("f").toArrow().column(0)))
    for v in (0, 1):
        for good in (False, True):
            own = [x for u, g, x in found if (u, g) == (v, good)]
            q = np.sort(p[:, v] if good else 1 - p[:, v])[::-1][:10]
            got = model.scores(np.stack(own))[:, v]
            assert len(own) == 10 and np.allclose(np.sort(got if good else 1 - got)[::-1], q)


def test_quality_on_odd_documents(spark, scratch):
    docs = odd_documents(spark)
    few = spark.createDataFrame([(0, 1, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = classify(scratch, docs, few)
    assert out.count() == docs.count() and out.where("kept").count() == docs.count()
    assert {r["p_quality"] for r in classify(scratch, docs, few.limit(0)).collect()} == {0.5}
    both = spark.createDataFrame([(0, 1, 0), (8, 0, 0), (9, 0, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert classify(scratch, docs, both).where("p_quality is null").count() == 0
