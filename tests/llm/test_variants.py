"""Spelling variants against plain Python, and their edge cases."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm.variants import Automaton, near_words, pieces, variants

SCHEMA = "doc_id long, text string, word string, n int, key long, m int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97):
    count = Counter()
    for doc_id, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            count[r] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    out, forms = {}, {}
    for w in n:
        near = [x for x in n if one_error(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(near)

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n[w], out[w], n.get(forms[w])) for w in n), n


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def texts(seed=1, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "ÀÉÎÕÜ", "àéîõü"]
    rows = []
    for i in range(docs):
        words = [rng.choice(base) for _ in range(120)]
        for k, w in enumerate(words):
            if rng.random() < 0.4:
                p = rng.randrange(len(w))
                words[k] = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p:], w[:p] + rng.choice("abcé") + w[p + 1 :], w.upper(), w.capitalize()])
        rows.append((i, rng.choice([" ", ", ", "1", "×", "\n"]).join(words)))  # the multiplication sign is in the range of letters
    return rows + [(None, "abcab abcab abcab"), (3, rows[3][1]), (3, rows[3][1]), (70, None), (71, ""), (72, "1234 !"), (73, "ab cd")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], SCHEMA)


def test_variants(spark, scratch):
    rows = texts() + [(80, "chainaa " * 4 + "chainab " * 9 + "chainbb " * 20 + "chaincb " * 20 + "chbinbb " * 41)]
    want, n = brute(rows)
    assert any(f is not None for _, f, *_ in want) and any(r != f for _, f, r, *_ in want if f is not None)
    assert got(variants(scratch, table(spark, rows))) == want


def test_every_run_hashed(spark, scratch):
    """With every hash divided, each run loses a point."""
    rows = texts(2, 20)
    assert got(variants(scratch, table(spark, rows), every=1)) == brute(rows, 1)[0]


def test_no_words(spark, scratch):
    assert got(variants(scratch, table(spark, []))) == []
    assert got(variants(scratch, table(spark, [(1, None), (2, "ab")]))) == []


def test_crowded_cells(spark, scratch):
    """Words that share their beginning and end: cells are halved until they are small, and no pair is lost."""
    rng = random.Random(4)
    words = sorted({"commonbegin" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) + "commonend" for _ in range(90)} | {"x" * k for k in range(5, 30)})
    vocabulary = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n long")
    found = {(r["word"], r["near"], r["near_n"]) for r in near_words(scratch, vocabulary, crowd=10, task_rows=50).collect()}
    assert found == {(a, b, words.index(b) + 3) for a in words for b in words if one_error(a, b)}


def test_automaton_numbers_and_size():
    words = sorted({a + b + c for a in ("re", "un", "in") for b in ("do", "tie", "pack") for c in ("", "s", "ed", "ing")})
    auto = Automaton(words)
    assert [auto.number(w) for w in words] == list(range(len(words))) and auto.number("redoes") == -1 and auto.number("") == -1
    trie = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(auto.edges) < len(trie) // 2  # equal endings are one state
    for w in [*words, "redox", "untieds"]:
        for fixed in (0, 2, len(w)):
            assert {words[k] for k in auto.near(w, fixed)} == {x for x in words if one_error(w, x) and x.startswith(w[:fixed])}
    assert Automaton([]).near("abc", 0) == [] and Automaton([]).number("") == -1


def test_pieces_cut_no_run(spark):
    rng = random.Random(7)
    rows = ["".join(rng.choice(["a" * rng.randint(1, 40), " ", "é!", "B"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    runs = lambda t: re.findall("[A-Za-zÀ-ÿ]+", t)
    for r in df.select("i", pieces(F.col("t"), 7).alias("p")).collect():
        assert [x for p in r["p"] for x in runs(p)] == runs(rows[r["i"]])


def test_long_text(spark, scratch):
    rows = [(1, "lengthy " * 300_000 + "lengthi " * 3), (2, "z" * 50_000 + " " + "z" * 50_001)] + [(i, "z" * 50_000) for i in range(3, 6)]
    assert got(variants(scratch, table(spark, rows), every=1 << 40)) == [("lengthi", "lengthy", "lengthy", 3, 1, 300_000), ("lengthy", None, "lengthy", 300_000, 1, None), ("z" * 50_000, None, "z" * 50_000, 4, 0, None)]
