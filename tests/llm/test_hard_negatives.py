"""Hard negatives against brute force, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm.hard_negatives import Lists, first_shells, hard_negatives, k_means, products

SCHEMA = "vec_id long, embedding array<double>, label int, id int, v string, h long, score int"


def brute(rows, anchors, k=5, n=5, window=(80, 100), scale=256):
    good = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(scale * x) for x in v), lab))
    good, out = list(good), []
    for a, q, lab in good:
        if not anchors(a):
            continue
        scored = sorted(((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), i, other) for i, v, other in good if i != a and len(v) == len(q)), key=lambda t: t[:2])
        for s, p, _ in [t for t in scored if t[2] == lab][:k]:
            found = [(i, -t) for t, i, other in scored if other != lab and -s * window[0] <= -100 * t <= -s * window[1]][:n]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], SCHEMA)


def got(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def vectors(n=400, dim=8, labels=3, spread=0.3, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    return [(i, (centre[i % 12] + rng.standard_normal(dim) * spread).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("lists, first, part_rows, ask_rows, spread", [(None, 0.05, 2048, 1024, 0.3), (24, 0.01, 16, 3, 0.05), (1, 1.0, 64, 64, 2.0)])
def test_against_brute_force(spark, scratch, lists, first, part_rows, ask_rows, spread):
    rows = vectors(spread=spread)
    same = rows[10][1]
    rows += [(500 + i, same, i % 3) for i in range(30)]  # copies: ties in score
    rows += [(600, None, 1), (610, [None] + same[1:], 1), (620, [float("nan")] + same[1:], 1), (630, [float("inf")] + same[1:], 1), (640, same, None), (650, same[:-1], 1), (651, same[:-1], 2), (652, same[:-1], 1), (660, [], 1), (661, [], 2), (662, [], 1), (670, [0.0] * 8, 1), (None, same, 1), (10, same, 1), (10, same, 2), (20, rows[21][1], 0)]
    t = table(spark, rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and any(a == 650 for a, *_ in want) and any(a == 660 for a, *_ in want)
    assert got(hard_negatives(scratch, t, t.where("vec_id % 10 = 0"), lists=lists, first=first, part_rows=part_rows, ask_rows=ask_rows)) == want


def test_other_windows_and_numbers(spark, scratch):
    rows = vectors(200, spread=0.5, seed=3)
    t = table(spark, rows)
    for window in ((50, 95), (100, 100), (90, 120)):
        assert got(hard_negatives(scratch, t, t.where("vec_id < 20"), positives=3, negatives=7, window=window)) == brute(rows, lambda i: i < 20, 3, 7, window)


def test_few_rows(spark, scratch):
    assert got(hard_negatives(scratch, table(spark, []), table(spark, []))) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.89, 0.1], 2)]
    t = table(spark, rows)
    assert got(hard_negatives(scratch, t, t.where("vec_id = 0"))) == brute(rows, lambda i: i == 0) == [(0, 1, 1, 2, 58880, 58112)]
    assert got(hard_negatives(scratch, t.where("vec_id < 2"), t.where("vec_id = 0"))) == []
    assert got(hard_negatives(scratch, t, t.where("vec_id = 2"))) == []


def test_large_components(spark, scratch):
    """Scores beyond what doubles hold are exact, those beyond 64 bits are cut."""
    for size in (1e6, 1e9):
        rows = [(i, [size + i * 3.0, 2 * size - i, size * (i % 3)], i % 2) for i in range(20)]
        t = table(spark, rows)
        want = brute(rows, lambda i: i % 5 == 0)
        assert want and got(hard_negatives(scratch, t, t.where("vec_id % 5 = 0"))) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.standard_normal(6) * 4 + rng.standard_normal((100, 6)) * 0.1 for _ in range(20)]))
    lists = Lists(x, 20, 1)
    home, shell, far = lists.file(x)
    keys = sorted(set(zip(home.tolist(), shell.tolist(), strict=True)))
    lists.hold([(a, b, far[(home == a) & (shell == b)].max(), int(((home == a) & (shell == b)).sum())) for a, b in keys])
    skipped = 0
    for a in x[::50]:
        lower, upper = lists.bounds(a)
        s = x @ a
        for (i, j), lo, hi in zip(keys, lower, upper, strict=True):
            own = s[(home == i) & (shell == j)]
            assert lo <= own.min() and own.max() <= hi
        skipped += int((upper < np.sort(s)[-5]).sum())
        seen = first_shells(lists, upper, np.ones(len(upper), bool), 100)
        assert lists.rows[seen].sum() >= 100 and upper[seen].min() >= upper[~seen].max()
    assert skipped > 0.7 * len(keys) * len(x[::50])  # clustered vectors: most shells are ruled out
    assert len(k_means(x[:3], 10, 1)) <= 3
    assert products(np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0]]))[0, 0] == 2**63 - 1
    assert products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0]]))[0, 0] == 2**60 + 3


def test_query_is_whole(spark):
    from vellum.llm.queries import op12_hard_negatives

    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    assert got(op12_hard_negatives(spark, "/root/testdata/sf0.001")) == brute(rows, lambda i: i % 100 == 0)
