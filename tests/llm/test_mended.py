"""Cases that once went wrong."""

import numpy as np
import pytest

from vellum.llm import common
from vellum.llm.common import lookup
from vellum.llm.embed_dedup import near_vectors
from vellum.llm.html_extract import extract, extract_page
from vellum.llm.minhash import LONG_WORD, near_duplicates, word_hashes


def test_null_ids_link_with_nothing(spark, scratch):
    v = [1.0, 2.0, 3.0]
    t = spark.createDataFrame([(None, v, 1), (2, v, 1), (3, [1.0, 2.0, 3.1], 1), (None, [1.0, 2.0, 3.1], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(scratch, t).collect())
    assert got == [(-1, 0, None, True), (-1, 0, None, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_patterns_of_two_letters_do_not_collide(spark, scratch):
    """A long word of a self-similar pattern and its complement have one polynomial hash modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    t = spark.createDataFrame([(1, word), (2, other), (3, word), (4, word[:64]), (5, other[:64])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(scratch, t).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_word_hashes():
    words = [b"a", b"b", b"ab", b"ba", b"abcdefgh", b"abcdefgi", b"abcdefgha", b"a\0", b"x" * LONG_WORD, b"x" * (LONG_WORD + 1), b"y" * 5000, b"y" * 5001]
    words += [w[::-1] + b"q" for w in words]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = end - np.array([len(w) for w in words])
    first = word_hashes(data, begin, end)
    assert len(set(first.tolist())) == len(words)
    for i, w in enumerate(words):  # whatever stands around them
        assert word_hashes(np.frombuffer(b"zz" + w, np.uint8), np.array([2]), np.array([2 + len(w)]))[0] == first[i]


@pytest.mark.parametrize("rows, held", [(200_000, 0), (1 << 30, 0), (1 << 30, 1 << 30)])
def test_lookup_counts_bytes(spark, monkeypatch, rows, held):
    """A few long rows are no small side; what comes out is the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "SMALL", rows)
    monkeypatch.setattr(common, "SMALL_BYTES", held)
    left = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(60)], "i int, k string")
    small = spark.createDataFrame([("hot", "x" * 1000), ("3", "y"), ("none", "z")], "k string, v string")
    found = lookup(left, small, ["k"], F.xxhash64("i"), "left")
    assert ("broadcast" in found._jdf.queryExecution().toString().lower()) == (held > 0)
    assert sorted((r["i"], r["v"]) for r in found.collect()) == [(i, "x" * 1000 if i % 3 else "y" if i == 3 else None) for i in range(60)]


SENTENCE = "This is a sentence of the story that goes on for a while. "


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p>one <span class='share'>two</p><p>three</p><p>four</p></article>", "one two\n\nthree\n\nfour"),
        ("<article><p>one <span class='ad'>two</p><p>three</p></article>", "one\n\nthree"),
        ("<article><pre>x = 1 <span class='comment'># set x</span></pre></article>", "x = 1 # set x"),
        ("<article><p>see the <a class='related-link' href='x'>second chapter</a> of it, and <a class='nav-link'>the third</a>, of this long book</p></article>", "see the second chapter of it, and the third, of this long book"),
        ("<article><ul><li class='item share'>Share price of the firm</li><li>more</li><li class='ad'>buy</li></ul></article>", "Share price of the firm\n\nmore"),
        ("<article><p>text <span class='ad'><span>buy</span> now <i>cheap</i></span> goes on</p></article>", "text goes on"),
        ("<article><ol class='comment-list'><li class='comment'>me too</li></ol><p>text</p></article>", "text"),
        (f"<body><div class='lead'>Lead of it all.</div><div><div><div class='body'><p>{SENTENCE * 5}</p></div></div></div></body>", "Lead of it all.\n\n" + (SENTENCE * 5).strip()),
        (f"<body><article>{SENTENCE * 7}</article><article>{SENTENCE * 3}</article></body>", (SENTENCE * 7).strip() + "\n\n" + (SENTENCE * 3).strip()),
        (f"<body><h1>Title</h1><article><p>{SENTENCE * 4}</p></article><div><a href='/'>home</a> <a href='/x'>all</a></div></body>", "Title\n\n" + (SENTENCE * 4).strip()),
    ],
)
def test_article_text_stays(html, text):
    assert extract_page(html, []) == text


def test_what_repeats_on_a_host_goes(spark, scratch):
    """A slogan in a container without any name comes back on the host's pages; leads there vary and stay."""
    rows = []
    for i in range(12):
        page = f"<body><div>Lead number {'abcdefghijkl'[i]}.</div><div><article><p>{SENTENCE * 3}{i}</p></article></div><div>The best site, page {i} of 12</div></body>"
        rows.append((i, "http://site.example.com/" + str(i), page))
    rows.append((99, "http://other.example.com/1", f"<body><div>The best site, page 1 of 12</div><article>{SENTENCE}</article></body>"))
    got = {r["page_id"]: r["text"] for r in extract(scratch, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Lead number {'abcdefghijkl'[i]}.\n\n{SENTENCE * 3}{i}" for i in range(12))
    assert got[99] == "The best site, page 1 of 12\n\n" + SENTENCE.strip()
