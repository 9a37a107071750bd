"""Operators on vectors and pages against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import html_extract, url_rules
from vellum.llm.ann import Tree, nearest
from vellum.llm.common import connected_components
from vellum.llm.embed_dedup import best_number, cells_of, near_vectors
from vellum.llm.queries import URL_RULES, op8_nearest_neighbours

VECS = "vec_id long, embedding array<float>, label int, k int, v string, cell int"


def odd_vectors(spark, n=240, dim=16):
    rng = np.random.default_rng(2)
    rows, base = [], rng.standard_normal((12, dim))
    for i in range(n):
        x = base[i % 12] + rng.standard_normal(dim) * (0.02 if i % 3 else 0.5)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 2))
    same = rows[5][1]
    rows += [(n + i, same, 1) for i in range(40)]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [None] + same[1:], 1), (903, [float("nan")] + same[1:], 1), (904, [float("inf")] + same[1:], 1), (905, same, None), (906, same[:-1], 1), (907, [], 1), (908, [v * 1e-20 for v in same], 1), (5, same, 1)]
    return spark.createDataFrame([(*r, 1, "v", 2) for r in rows], VECS)


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("pivots, block_rows", [(None, 1024), (1, 1024), (12, 16)])
def test_embedding_dedup(spark, scratch, components, pivots, block_rows):
    table = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    n, edges = [0] * len(rows), []
    unit = [np.array(v, float) / np.abs(v).max() if good(v) else None for _, v, _ in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    for i, (a, _, la) in enumerate(rows):
        for j, (b, _, lb) in enumerate(rows):
            if i != j and unit[i] is not None and unit[j] is not None and la is not None and la == lb and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i] += 1
                edges.append((a, b))
    comp = components([a for a, _, _ in rows], edges)
    got = near_vectors(scratch, table, pivots=pivots, block_rows=block_rows).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((a, k, comp[a]) for (a, _, _), k in zip(rows, n, strict=True))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_scaled_copies_as_pivots(spark, scratch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base * (1 + i / 7)).tolist(), 1) for i in range(60)]
    rows += [(60 + i, (base + rng.standard_normal(16) * 0.15).tolist(), 1) for i in range(60)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = near_vectors(scratch, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), pivots=8, block_rows=16).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))


def test_no_vectors(spark, scratch):
    none = odd_vectors(spark).limit(0)
    assert near_vectors(scratch, none).count() == 0 and nearest(scratch, none, none).count() == 0
    few = odd_vectors(spark).where("vec_id in (0, 1, 900, 901, 906)")
    assert nearest(scratch, few, few).count() == 2  # each of the two finds the other


def brute_nearest(rows, queries, k=10):
    out = {}
    for q, v in queries:
        if not good(v):
            continue
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in rows if good(x) and len(x) == len(v) and i != q)
        out.setdefault(q, d[:k])
    return out


def test_exact_search_when_every_leaf_is_read(spark, scratch):
    table = odd_vectors(spark).where("vec_id <> 5")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {}
    for r in nearest(scratch, table, table.where("vec_id % 20 = 0"), share=4.0, leaf_share=0.1, part_rows=50, query_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)


def test_more_pivots_where_vectors_have_clusters():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((64, 32)) * 3
    clustered = centres[rng.integers(0, 64, 2000)] + rng.standard_normal((2000, 32)) * 0.1
    other, reach = rng.standard_normal((2000, 32)), float(np.sqrt(2 - 2 * 0.93))
    clustered, other = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (clustered, other))
    assert best_number(clustered, reach, 10_000_000, 10) >= 32 and best_number(clustered, reach, 500, 10) == 4
    assert best_number(other, 1.3, 10_000_000, 10) == 4  # nothing to prune: more cells would only mean more copies


def test_cells_lose_no_partner():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = 0.4
    home, goes = cells_of(x, x[:20], reach)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= reach
    assert goes.mean() < 0.9 and all(goes[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True))


def test_recall(spark, sf_dir):
    """The query on its own table, and its search on one of 12,000 vectors without clusters: neither reads every leaf."""
    from vellum.llm.common import Scratch

    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((12_000, 32)).astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    for table, found in ((spark.read.parquet(f"{sf_dir}/embeddings.parquet"), op8_nearest_neighbours(spark, sf_dir)), (many, nearest(Scratch(spark), many, many.where("vec_id % 100 = 0")))):
        rows = table.select("vec_id", "embedding").toArrow()
        ids = rows.column(0).to_numpy()
        x = np.array(rows.column(1).to_pylist(), np.float64)
        got: dict[int, set[int]] = {}
        for r in found.collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = total = 0
        for q in np.flatnonzero(ids % 100 == 0):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            hits, total = hits + len(got[int(ids[q])] & set(ids[np.lexsort((ids, d))[:10]].tolist())), total + 10
        assert 0.9 <= hits / total


def test_trees_of_equal_vectors_end():
    t = Tree(np.ones((50, 4)), 5, np.random.default_rng(0))
    assert t.leaves == 1 and set(t.file(np.ones((3, 4)))) == {0}


def test_components_of_a_chain_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (7, 8), (8, 7)]
    got = dict(connected_components(scratch, spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}}
    assert connected_components(scratch, spark.createDataFrame([], "a long, b long"), "none").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="post-12"><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One  two<br>three <span class="ad">buy</span>four<p>F&eacute;&#233; <a href="/x>y">six</a></p><ul><li>a<li>b</ul>
<form><input><p>mail</p></form><aside>side</aside></article><section class="comments"><p>me too, a long comment that says nothing at all</p></section><div id="cookie-notice">ok</div><footer>f</footer></body></html>"""


def test_page():
    assert html_extract.extract_page(PAGE, []) == "Head & line\n\nOne two three four\n\nFéé six\n\na\n\nb"
    p = html_extract.Page(PAGE)
    assert p.path(p.choice()) == "html>body.post-0>article"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain &lt; x", "plain < x"), ("<p>a</p", "a"), ("<script>x</script>y", "y"), ("<p>x &am", "x &am"), ("<p", ""), ("<!-- open", ""), ("<div hidden>x</div><p>y", "y"), ("</p></div>z", "z"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip())])
def test_odd_pages(html, text):
    assert html_extract.extract_page(html, [("html>body>article", 1.0)]) == text


@pytest.mark.parametrize("name", ["with-sidebar", "no-sidebar", "content-social", "post category-social", "page-header-fixed", "header", "site-header"])
@pytest.mark.parametrize("inner", ["<article><p>own text</p></article>", "<main><p>own text</p></main>", "<p>own text</p>"])
def test_a_wrapper_keeps_its_text(name, inner):
    page = f'<body><div class="{name}">{inner}<div class="comments"><p>me</p></div><div id="social-share">x</div></div><div class="ad">buy</div></body>'
    assert html_extract.extract_page(page, []) == "own text"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p title=don't>Hello it is me</p><p>second para isn't here</p></article>", "Hello it is me\n\nsecond para isn't here"),
        ("<p>a<!-->b<!--->c<!-- d --!>e<!-- f -->g", "abceg"),
        ("<div class='elementor-widget-text'><article>x</article></div>", "x"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>own text</p></article><header><h1>Site</h1></header>", "Title\n\nown text"),
        ("<p a='x>y' b=\"'>\" c = 'z'>t</p>", "t"),
        ("<article><p>one<p>two</div></section></article>", "one\n\ntwo"),
    ],
)
def test_markup(html, text):
    assert html_extract.extract_page(html, []) == text


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (4_000, 32_000):
        html, began = "<div class='ad-list x'>" * n + "<p>deep</p>" + "</div></section>" * n + "<article>" * n + "own", time.perf_counter()
        page = html_extract.Page(html)
        page.choice()
        page.by_path(page.path(len(page.elements) - 1))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0] + 1


def generated_page(rng, kind, body):
    """A page of one of several templates around blocks of text, which are what its article says."""
    blocks = "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<div>{b}</div>" for b in body)
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>menu {i}</a>" for i in range(int(rng.integers(2, 6)))) + "</ul></nav>"
    side = "<aside><p>aside words</p></aside>" if rng.random() < 0.5 else "<div class='sidebar'><p>side words</p></div>"
    ad, foot = "<div class='ad'>buy this</div>", "<footer><p>foot</p></footer>"
    return [
        f"<html><body>{nav}{ad}<article>{blocks}{ad}</article>{side}{foot}</body></html>",
        f"<body><header><h1>Site</h1>{nav}</header><main id=m><div class='post post-{rng.integers(9)}'>{blocks}</div><form><input>mail</form></main>{foot}</body>",
        f"<body>{nav}<div class='wrap no-sidebar'><section class='content'>{blocks}</section><div class='comments'><p>me too</p></div></div>{side}{foot}<script>var a='<p>x</p>'</script></body>",
        f"<table><tr><td>{nav}<td>{blocks}</table><div role=contentinfo>imprint</div>{ad}",
    ][kind]


@pytest.mark.parametrize("kind", range(4))
def test_generated_pages_of_several_templates(spark, scratch, kind):
    rng = np.random.default_rng(kind)
    words = ["alpha", "beta", "gamma", "&eacute;t&eacute;", "1 &lt; 2", "don't", "A&amp;B", "two\n words", "delta.", "epsilon,"]
    from html import unescape

    rows, want = [], {}
    for i in range(25):
        body = [" ".join(rng.choice(words, int(rng.integers(20, 60)))) for _ in range(int(rng.integers(2, 7)))]
        want[i] = "\n\n".join(" ".join(unescape(b).split()) for b in body)
        rows.append((i, f"http://h{i % 2}.example/{i}", generated_page(rng, kind, body)))
    got = html_extract.extract(scratch, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("_html", "_host", "_paths", "text")}))
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_main_beside_its_article():
    page = "<body><main><h1>Head</h1><p>Lead.</p><article><p>" + "own text " * 40 + "</p></article><nav>menu</nav><div class='share-buttons'>x</div></main><footer>f</footer></body>"
    assert html_extract.extract_page(page, []) == "Head\n\nLead.\n\n" + ("own text " * 40).strip()
    comments = "<body><div class='post'><p>short</p></div><div class='comments-area'><article><p>a much longer comment</p></article></div></body>"
    assert html_extract.extract_page(comments, []) == "short"


def test_consensus_of_a_host(spark, scratch):
    body = "<body><div class='main-{n}'><p>{a}</p></div><div class='other'><p>{b}</p></div></body>"
    rows = [(i, "http://h.example/p", body.format(n=i, a="the article's own text " * 9, b="x")) for i in range(5)]
    rows += [(9, "http://H.example/q", body.format(n=9, a="short article", b="a long teaser for something else " * 9)), (10, None, None), (11, "http://z.example", "<p>alone</p>"), (11, "http://z.example", "<p>alone</p>")]
    got = html_extract.extract(scratch, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).orderBy("page_id").collect()
    assert [r["text"] for r in got if r["page_id"] >= 9] == ["short article", "", "alone", "alone"]
    assert html_extract.extract(scratch, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fixed_rules(spark, scratch):
    urls = ["https://a.COM/en/1", "http://x.example.com/en/71?q", "http://example.com/en/81", "http://b.net/de/", "http://w.example.net/de/8", "http://notnet/de/", "http://q.org/es/#x", None, "no scheme", "http://c.com", "http://mynet.de/x://y/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [tuple(r) for r in url_rules.judge(scratch, pages, url_rules.mine(scratch, spark.createDataFrame([], "url string, bad boolean")), URL_RULES).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.com", "/en/1", "com/en/", "block"),
        ("x.example.com", "/en/71", "example.com/en/7", "allow"),
        ("example.com", "/en/81", "com/en/", "block"),
        ("b.net", "/de/", "net/de/", "allow"),
        ("w.example.net", "/de/8", "example.net/de/8", "block"),
        ("notnet", "/de/", None, "allow"),
        ("q.org", "/es/", "org/es/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("c.com", "", None, "allow"),
        ("mynet.de", "/x://y/de/", None, "allow"),
    ]


def labelled_urls():
    rng = np.random.default_rng(3)
    rows = [(f"http://www.spam{i % 2}.example/buy/{i}", i % 9 > 0) for i in range(120)] + [(f"http://ok{i % 40}.example/{rng.choice(['buy', 'read'])}/{i}", bool(rng.random() < 0.1)) for i in range(400)]
    return [*rows, *rows[:3], (None, True), ("http://x", None), ("no scheme", False)]


def test_mined_rules(spark, scratch):
    rules = url_rules.mine(scratch, spark.createDataFrame(labelled_urls(), "url string, bad boolean"))
    found = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert ("w:spam0",) in found and all(c > 0.3 for c in found.values()) and not any("ok" in t for k in found for t in k)
    assert all(r["tok"] in r["tokens"] for r in rules.collect())
    pages = spark.createDataFrame([(0, "http://shop.spam0.example/new"), (1, "http://ok77.example/read/3"), (1, "http://ok77.example/read/3"), (2, None)], "page_id long, url string").withColumn("_t", F.lit("own"))
    assert [r["verdict"] for r in url_rules.judge(scratch, pages, rules, []).orderBy("page_id").collect()] == ["block", "allow", "allow", "allow"]
    assert url_rules.judge(scratch, pages.limit(0), rules, []).count() == 0


def tokens(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [set(r[0]) for r in df.select(url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))).collect()]


def test_rules_against_a_count(spark, scratch):
    """Every rule by brute force: combinations of the pages' tokens, counted on the mined and the held-out pages."""
    from itertools import combinations
    from math import sqrt

    rows = [r for r in labelled_urls() if r[0] is not None and r[1] is not None]
    sets = tokens(spark, [u for u, _ in rows])
    held = [r[0] for r in spark.createDataFrame([(u,) for u, _ in rows], "url string").select(F.pmod(F.xxhash64("url"), F.lit(4)) == 0).collect()]
    n, mined, pages = {}, [i for i, h in enumerate(held) if not h], {}
    for i, own in enumerate(sets):
        for t in own:
            pages.setdefault(t, []).append(i)
    stands: dict[tuple, str] = {}
    for t, at in pages.items():
        stands[tuple(at)] = max(t, stands.get(tuple(at), ""))
    sets = [own & set(stands.values()) for own in sets]
    base = sum(rows[i][1] for i in mined) / len(mined)
    for i, own in enumerate(sets):
        for k in (1, 2, 3):
            for c in combinations(sorted(own), k):
                x = n.setdefault(c, [0, 0, 0, 0])
                x[2 * held[i]] += 1
                x[2 * held[i] + 1] += rows[i][1]
    z, good = 1.64, {}
    for c, (m, b, hm, hb) in n.items():
        if b >= 5:
            p = b / m
            low = (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if p >= 1.5 * base and low > base and hb > base * hm:
                good[c] = p
    want = {c for c, p in good.items() if not any(set(o) < set(c) and q >= p for o, q in good.items())}
    got = url_rules.mine(scratch, spark.createDataFrame(rows, "url string, bad boolean"), min_support=0.0)
    assert {tuple(r["tokens"]) for r in got.collect()} == want and want


def test_long_paths_that_repeat_are_mined_at_once(spark, scratch):
    long = "/".join(f"part{chr(97 + i)}" for i in range(24))
    rows = [(f"http://h.example/{long}/x{i}y", True) for i in range(40)] + [(f"http://g.example/other/{i}", False) for i in range(80)]
    rules = url_rules.mine(scratch, spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert 1 <= len(rules) <= 3 and all(r["confidence"] == 1 and len(r["tokens"]) == 1 for r in rules)


def test_salted_lookup(spark, monkeypatch):
    from vellum.llm import common

    left, small = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, k int"), spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    want = sorted((i, i % 3, "ab"[i % 3] if i % 3 < 2 else None) for i in range(60))
    for bound in (10, 1):
        monkeypatch.setattr(common, "SMALL", bound)
        got = common.lookup(left, small, ["k"], F.xxhash64("id"), "left").select("id", "k", "v").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == want
