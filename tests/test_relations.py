"""Relational operators against the reader's own answers and plain loops."""

import random

from pyspark.sql import functions as F

from vellum.core.fonts import FirstMatch, codes
from vellum.operators.ranges import disjoint, first_match
from vellum.operators.text import cid_widths, code_steps, decode_codes

RANGE = "doc_id long, num long, gen long, pos int, lo long, hi long, width double"


def some_ranges(rng, n, top):
    out = []
    for pos in range(n):
        lo = rng.randrange(top)
        out.append((pos, lo, lo + rng.choice([0, 0, 1, 5, top // 2, -2]), float(pos)))
    return out


def test_first_match(spark):
    rng = random.Random(2)
    fonts = {k: some_ranges(rng, n, top) for k, (n, top) in enumerate([(1, 9), (40, 30), (200, 4000), (60, 60), (300, 100)])}
    fonts[7] = [(i, i, 1000 - i, float(i)) for i in range(300)]  # nested, the widest first
    fonts[8] = [(i, 300 - i, 700 + i, float(i)) for i in range(300)]  # nested, the narrowest first
    rows = [(k, 1, 0, *r) for k, own in fonts.items() for r in own]
    ranges = spark.createDataFrame(rows, RANGE)
    asked = [(k, 1, 0, c) for k in fonts for c in range(-1, 1100, 3)] * 2 + [(99, 1, 0, 5)]
    got = first_match(spark.createDataFrame(asked, "doc_id long, num long, gen long, cid long"), ranges, ["doc_id", "num", "gen"], "cid", ["width", "lo"]).collect()
    assert len(got) == len(asked)
    for r in got:
        found = FirstMatch([(lo, hi, w) for _, lo, hi, w in fonts.get(r["doc_id"], [])]).find(r["cid"])
        assert (r["width"], r["lo"]) == ((None, None) if found is None else (found[2], found[0]))


def test_segments_grow_with_ranges(spark):
    """Two thousand ranges, each within the one before: as many segments as ends, and none that overlap."""
    n = 2000
    ranges = spark.createDataFrame([(1, 1, 0, i, i, 3 * n - i, float(i)) for i in range(n)], RANGE)
    rows = sorted((r["lo"], r["hi"], r["width"]) for r in disjoint(ranges, ["doc_id", "num", "gen"], ["width"]).collect())
    assert len(rows) <= 2 * n and all(a[1] < b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert rows[0] == (0, 0, 0.0) and sum(hi - lo + 1 for lo, hi, _ in rows) == 3 * n + 1 and {w for *_, w in rows} == {0.0}


def test_widths_without_codes_or_ranges(spark):
    ranges = spark.createDataFrame([(1, 1, 0, 0, 5, 9, 300.0)], RANGE).withColumn("default_width", F.lit(450.0))
    none = spark.createDataFrame([], "doc_id long, num long, gen long, cid long")
    assert cid_widths(none, ranges).collect() == []
    asked = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 0, 10), (2, 1, 0, 5)], "doc_id long, num long, gen long, cid long")
    assert sorted((r["doc_id"], r["cid"], r["width"]) for r in cid_widths(asked, ranges).collect()) == [(1, 5, 300.0), (1, 10, 450.0), (2, 5, 1000.0)]


def test_codes_of_several_lengths(spark):
    rng = random.Random(3)
    spaces = [(1, 0x20, 0x7E), (2, 0x8140, 0x9FFC), (2, 0x2000, 0x20FF), (3, 0xE00000, 0xE0FFFF)]
    strings = [bytes(rng.choice([0x20, 0x41, 0x81, 0x50, 0xE0, 0xFF, 0x9F]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [b"", b"\x81", b"\xff" * 9]
    held = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("bytes"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for i, (n, lo, hi) in enumerate(spaces)])
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(strings)], "i int, b binary")
    for r in df.select("i", code_steps(F.col("b"), held).alias("c")).collect():
        assert [c["code"] for c in r["c"]] == codes(strings[r["i"]], spaces)


def test_decoding(spark):
    key = (1, 5, 0)
    spaces = spark.createDataFrame([(*key, "unicode", 0, 1, 0x20, 0x7E), (*key, "unicode", 1, 2, 0x8140, 0x9FFC), (*key, "cid", 0, 2, 0, 0xFFFF)], "doc_id long, num long, gen long, of string, pos int, bytes int, lo long, hi long")
    maps = spark.createDataFrame([(*key, 0, 0x41, 0x41, "first"), (*key, 1, 0x20, 0x7E, " "), (*key, 2, 0x8140, 0x81FF, "xa"), (*key, 3, 0x8150, 0x8150, "never"), (*key, 4, 0x9000, 0x9000, "")], "doc_id long, num long, gen long, pos int, lo long, hi long, text string")
    strings = [b"A B", b"\x81\x40\x81\x42C", b"\xffA\x81", b"\x90\x00B", b"", b"\x81\x50"]
    df = spark.createDataFrame([(*key, i, bytearray(b)) for i, b in enumerate(strings)], "doc_id long, num long, gen long, sid int, bytes binary")
    assert {r["sid"]: r["text"] for r in decode_codes(df, spaces, maps).collect()} == {0: "first B", 1: "xaxcC", 2: "first", 3: "B", 4: "", 5: "xq"}


# ---- the matrix of the graphics state, forms -----------------------------------------------------------------------

IM = b"/XObject << /Im 6 0 R /Fa 7 0 R /Fb 8 0 R /No 9 0 R >>"


def some_content(rng, n):
    words = [b"q", b"Q", b"Q", b"%d 0 0 2 1 %d cm" % (rng.randint(1, 3), rng.randint(-2, 2)), b"0 1 -1 0 0 0 cm", b"/Im Do", b"/Fa Do", b"/Fb Do", b"/No Do", b"/Gone Do", b"1 w"]
    return b" ".join(rng.choice(words) for _ in range(n))


def some_file(rng):
    from vellum import synth

    form = lambda own: b"/Type /XObject /Subtype /Form /BBox [0 0 1 1] /Matrix [1 0 0 1 %d 0] %s" % (rng.randint(0, 5), own)
    extra = {
        6: synth.stream(b"\x80", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8"),
        7: synth.stream(some_content(rng, 5), form(b"/Resources << /XObject << /Im 6 0 R /Fb 8 0 R /Fa 7 0 R >> >>")),
        8: synth.stream(some_content(rng, 6), form(b"")),
        9: synth.stream(some_content(rng, 4), form(b"/Resources << >>")),
    }
    return synth.one_page(some_content(rng, 25), IM, extra=extra).finish()


def test_images_of_pages_and_forms(spark):
    from vellum.operators.invocations import images
    from vellum.plans.tables import Engine

    rng = random.Random(8)
    docs = spark.createDataFrame([(i, bytearray(some_file(rng))) for i in range(30)] + [(99, bytearray(b"no file"))], "doc_id long, content binary")
    e = Engine(docs)
    shape = lambda r: (r["doc_id"], r["page_index"], r["seq"], r["num"], r["gen"], *(round(v, 6) for v in r["bounds"]), *(round(v, 6) for v in r["matrix"]))
    want = sorted(shape(r) for r in e.features(("image",)).select("doc_id", "page_index", "seq", "image.num", "image.gen", "bounds", "matrix").collect())
    assert len(want) > 100 and len({w[0] for w in want}) > 20
    assert sorted(map(shape, images(e).collect())) == want


def test_no_images(spark):
    from vellum.operators.invocations import images
    from vellum.plans.tables import Engine

    assert images(Engine(spark.createDataFrame([], "doc_id long, content binary"))).collect() == []


# ---- chains of sections ------------------------------------------------------------------------------------------


def walked(sections, start, end):
    by, order, seen = {s[0]: s for s in sections}, [], set()
    while start in by and start not in seen:
        seen.add(start)
        order.append(start)
        _, prev, hybrid = by[start]
        if hybrid is not None and hybrid not in seen and hybrid < end:
            seen.add(hybrid)
            order.append(hybrid)
        start = prev
    return order


def test_section_order(spark):
    from vellum.operators.chains import section_order

    rng = random.Random(5)
    files = {
        1: ([(i, i - 1 if i else None, None) for i in range(1000)], 999),  # a thousand revisions
        2: ([(5, 9, None), (9, 5, None)], 5),  # a circle
        3: ([(5, 5, None)], 5),
        4: ([(10, 8, 20), (20, None, None), (8, 6, 21), (6, None, 20), (21, None, None)], 10),  # hybrids, one twice
        5: ([(10, 8, 7), (8, 7, None), (7, 3, None), (3, None, None)], 10),  # a hybrid that the chain leads to
        6: ([(10, 77, None)], 10),  # leads nowhere
        7: ([(10, None, 5000), (5000, None, None)], 10),  # a hybrid past the end
    }
    for k in range(20, 40):
        n = rng.randint(1, 12)
        files[k] = ([(i, rng.choice([None, *range(n)]), rng.choice([None, None, *range(n)])) for i in range(n)], rng.randrange(n))
    rows = [(k, *s) for k, (own, _) in files.items() for s in own]
    rng.shuffle(rows)
    sections = spark.createDataFrame(rows, "doc_id long, at long, prev long, hybrid long")
    headers = spark.createDataFrame([(k, start, 2000) for k, (_, start) in files.items()], "doc_id long, xref_start long, xref_end long")
    got = {}
    for r in section_order(sections, headers).orderBy("section_ord").collect():
        got.setdefault(r["doc_id"], []).append(r["at"])
    for k, (own, start) in files.items():
        assert got[k] == walked(own, start, 2000), k


def test_layouts_of_sections(spark):
    from vellum import synth
    from vellum.operators.chains import layouts_of_sections
    from vellum.plans.tables import Engine

    rows = []
    for i in range(12):
        w = synth.one_page(b"")
        w.add(b"1", 5)
        out = w.finish_packed() if i % 3 == 0 else w.finish()
        for k in range(i if i % 3 else 0):
            out = w.update({5 + k % 2: b"%d" % k})
        rows.append((i, bytearray(out)))
    w = synth.one_page(b"")
    rows.append((50, bytearray(w.finish(xref=False))))  # recovered
    e = Engine(spark.createDataFrame(rows, "doc_id long, content binary"))
    shape = lambda r: (r["doc_id"], r["num"], r["gen"], r["revision"], tuple(x or -1 if not isinstance(x, str) else x for x in r["storage"]))
    want = sorted(map(shape, e.table("object_layouts").collect()))
    assert sorted(map(shape, layouts_of_sections(e.table("xref_sections"), e.table("headers")).collect())) == want


# ---- hits, scans of chunks -------------------------------------------------------------------------------------------


def test_hits_of_many_regions(spark):
    from vellum.operators.hits import hits

    rng = random.Random(6)
    box = lambda: (rng.uniform(-50, 600), rng.uniform(-50, 600), rng.choice([0.0, 0.5, 3.0, 40.0, 700.0]), rng.choice([0.0, 1.0, 9.0, 300.0]))
    features = [(d, p, i, box()) for d in (1, 2) for p in (0, 1) for i in range(60)] + [(3, 0, i, (10.0 * i, 0.0, 10.0, 10.0)) for i in range(200)] + [(3, 0, 900, None)]
    regions = [(d, p, i, box()) for d in (1, 2) for p in (0, 1) for i in range(25)] + [(3, 0, 0, (95.0, 5.0, 0.0, 0.0)), (3, 0, 1, (0.0, 10.0, 5000.0, 2.0)), (3, 0, 2, None), (4, 0, 0, box())]
    rect = "struct<x:double,y:double,width:double,height:double>"
    f = spark.createDataFrame(features, f"doc_id long, page_index int, seq int, bounds {rect}")
    r = spark.createDataFrame(regions, f"doc_id long, page_index int, region int, rect {rect}")
    touch = lambda a, b: all(a[i] <= b[i] + b[i + 2] and b[i] <= a[i] + a[i + 2] for i in (0, 1))
    want = sorted((d, p, i, k) for d, p, i, a in features for e, q, k, b in regions if (d, p) == (e, q) and a and b and touch(a, b))
    for most in (20_000, 3):
        assert sorted((x["doc_id"], x["page_index"], x["seq"], x["region"]) for x in hits(f, r, most).collect()) == want
    assert hits(f.limit(0), r).collect() == [] and hits(f, r.limit(0)).collect() == []


def broken(rng):
    words = [b"1 0 obj << >> endobj", b"12 0 obj", b"3  \n1\t0 obj (x)", b"stream", b"endstream", b"trailer << /Size 3 >>", b"x4 0 obj", b"5 0 object", b"upstream", b"7 0 obj", b"%" + b"z" * 20, b"\xff\x80\xe9", b"6 0 R"]
    return b"%PDF-1.4\n" + rng.choice([b" ", b"\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))


def test_scan_of_chunks(spark):
    from vellum.core.document import Document
    from vellum.operators.scan import chunks, markers, recovered

    rng = random.Random(9)
    files = [broken(rng) for _ in range(40)]
    want = []
    for i, data in enumerate(files):
        doc = Document(data)
        want += [(i, ref.num, ref.gen, at) for s in doc.sections for ref, at in s["offsets"].items()]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)] + [(90, bytearray()), (91, None)], "doc_id long, content binary")
    for size in (16, 50, 1 << 20):
        got = recovered(markers(chunks(docs, size))).collect()
        assert sorted((r["doc_id"], r["num"], r["gen"], r["offset"]) for r in got) == sorted(want)


def test_chunks_of_files(spark, tmp_path):
    """Tasks read ranges of a file, whole chunks with a byte before and some beyond; the scan is that of the whole content."""
    from pyspark.sql import functions as F

    from vellum.operators.scan import BEYOND, chunks, markers
    from vellum.sources.chunks import register

    register(spark)
    rng = random.Random(10)
    data = {name: b" ".join(broken(rng) for _ in range(20)) for name in ("a.pdf", "b.pdf", "c.txt")}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    (tmp_path / "empty.pdf").write_bytes(b"")
    rows = spark.read.format("file_chunks").option("size", 512).option("task", 2).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == sum(-(-len(data[n]) // 1024) for n in ("a.pdf", "b.pdf"))
    for r in rows.collect():
        whole = data[r["path"].rsplit("/", 1)[1]]
        assert bytes(r["data"]) == whole[r["start"] - r["lead"] : r["start"] + r["size"] + BEYOND]
    named = rows.withColumn("doc_id", F.element_at(F.split("path", "/"), -1))
    docs = spark.createDataFrame([(n, bytearray(b)) for n, b in data.items() if n != "c.txt"], "doc_id string, content binary")
    shape = lambda df: sorted((r["doc_id"], r["at"], r["kind"]) for r in df.collect())
    assert shape(markers(named)) == shape(markers(chunks(docs)))


# ---- paths ---------------------------------------------------------------------------------------------------------


def test_paths_like_the_reader(spark):
    """Random operators, illegal orders among them: the same paintings, clips and segments as the display list."""
    from vellum import synth
    from vellum.operators.paths import painted
    from vellum.plans.tables import Engine

    rng = random.Random(12)
    n = lambda k: b" ".join(b"%d" % rng.randint(0, 9) for _ in range(k))
    sizes = {b"m": 2, b"l": 2, b"c": 6, b"v": 4, b"y": 4, b"re": 4, b"h": 0}
    words = [*sizes, b"m", b"S", b"s", b"f", b"f*", b"B", b"b", b"b*", b"n", b"W", b"W*"]
    docs = []
    for i in range(40):
        body = b" ".join((n(sizes[w]) + b" " + w) if w in sizes else w for w in (rng.choice(words) for _ in range(50)))
        docs.append((i, bytearray(synth.one_page(body).finish())))
    e = Engine(spark.createDataFrame(docs, "doc_id long, content binary"))
    want = {}
    for r in e.table("display_list", columns=("seq", "verb", "path")).orderBy("doc_id", "seq").collect():
        want.setdefault(r["doc_id"], []).append((r["verb"], r["path"].split()))
    got = {}
    for r in painted(e.table("operators")).orderBy("doc_id", "seq", "part").collect():
        flat = []
        for s in r["segments"]:
            flat += [s["verb"], *("%g" % v for v in s["at"])]
        got.setdefault(r["doc_id"], []).append((r["verb"], flat))
    assert sum(map(len, want.values())) > 200
    number = lambda rows: {k: [(v, [t if t in "mlch" else float(t) for t in p]) for v, p in own] for k, own in rows.items()}
    assert number(got) == number(want)
    assert painted(e.table("operators").limit(0)).collect() == []


def test_clips_like_a_stack(spark):
    """Random q, Q, cm, rectangles and clips against a stack of states, a Q without a q among them."""
    from vellum import synth
    from vellum.operators.clips import visible
    from vellum.plans.tables import Engine

    rng, docs, want = random.Random(3), [], []
    for i in range(30):
        body, seq, page = [], 0, (0, 0, 100, 80)
        state, stack = ((1, 1, 0, 0), page), []
        for _ in range(40):
            what = rng.choice(["q", "Q", "cm", "f", "f", "Wn", "Wf"])
            if what == "q":
                stack.append(state)
            elif what == "Q":
                state = stack.pop() if stack else ((1, 1, 0, 0), page)
            elif what == "cm":
                a, d, x, y = rng.choice([1, 1, 2, -1]), rng.choice([1, 1, 2, -1]), rng.randint(-9, 9), rng.randint(-9, 9)
                (ma, md, mx, my), clip = state
                state = (a * ma, d * md, x * ma + mx, y * md + my), clip
                body.append(b"%d 0 0 %d %d %d cm" % (a, d, x, y))
                seq += 1
                continue
            else:
                r = [rng.randint(-20, 90) for _ in range(2)] + [rng.randint(-9, 60) for _ in range(2)]
                (ma, md, mx, my), clip = state
                xs, ys = sorted((r[0] * ma + mx, (r[0] + r[2]) * ma + mx)), sorted((r[1] * md + my, (r[1] + r[3]) * md + my))
                both = (max(xs[0], clip[0]), max(ys[0], clip[1]), min(xs[1], clip[2]), min(ys[1], clip[3]))
                body.append(b"%d %d %d %d re" % tuple(r))
                body += [b"W"] * (what[0] == "W") + [b"n" if what == "Wn" else b"f"]
                seq += len([b"re", *[b"W"] * (what[0] == "W")])
                if what != "Wn":
                    seen = clip[0] < clip[2] and clip[1] < clip[3] and both[0] <= both[2] and both[1] <= both[3]
                    want.append((i, seq, clip, both if seen else None))
                if what[0] == "W":
                    state = state[0], both
                seq += 1
                continue
            body.append(what.encode())
            seq += 1
        docs.append((i, bytearray(synth.one_page(b" ".join(body), page=b"/MediaBox [0 0 100 80]").finish())))
    e = Engine(spark.createDataFrame(docs, "doc_id long, content binary"))
    got = [(r["doc_id"], r["seq"], tuple(r["clip"]), tuple(r["visible"]) if r["visible"] else None) for r in visible(e).collect()]
    assert len(want) > 300 and sum(x[3] is not None for x in want) > 20
    assert sorted(got) == sorted(want)
    assert visible(Engine(spark.createDataFrame([], "doc_id long, content binary"))).collect() == []


# ---- where glyphs stand --------------------------------------------------------------------------------------------


def text_content(rng):
    n = lambda lo=-3, hi=9: b"%d" % rng.randint(lo, hi)
    word = lambda: b"(" + b"".join(rng.choice([b"A", b"b", b" ", b"z"]) for _ in range(rng.randint(1, 5))) + b")"
    sets = [lambda: n() + b" Tc", lambda: n() + b" Tw", lambda: n(20, 150) + b" Tz", lambda: n() + b" TL", lambda: n() + b" Ts", lambda: rng.choice([b"/F1 ", b"/F2 "]) + n(1, 20) + b" Tf"]
    moves = [lambda: n() + b" " + n() + b" Td", lambda: n() + b" " + n() + b" TD", lambda: b"2 0 1 1 " + n() + b" " + n() + b" Tm", lambda: b"T*"]
    shows = [lambda: word() + b" Tj", lambda: b"[" + word() + b" -200 " + word() + b" 50 30 " + word() + b"] TJ", lambda: word() + b" '", lambda: n() + b" " + n() + b" " + word() + b' "']
    out = [b"/F1 10 Tf"]
    for _ in range(4):
        out.append(rng.choice([b"q", b"q 2 0 0 1 3 4 cm", b"Q", b"1 0 0 3 0 0 cm", b"q 5 Tc", b"Q"]))
        out.append(rng.choice(sets)())
        if out[-2] == b"Q":
            out.append(b"/F2 7 Tf")
        out += [b"BT", *[rng.choice(rng.choice([sets, moves, shows, shows]))() for _ in range(7)], b"ET"]
    return b" ".join(out)


def test_glyphs_by_windows(spark):
    from vellum import synth
    from vellum.operators.measure import glyphs, origins, runs
    from vellum.plans.cut import cut
    from vellum.plans.tables import Engine

    rng = random.Random(14)
    second = synth.FONT.replace(b"/Helvetica", b"/Other").replace(b"500 ", b"310 ")
    docs = [(i, bytearray(synth.one_page(text_content(rng), b"/Font << /F1 5 0 R /F2 6 0 R >>", extra={5: synth.FONT, 6: second}).finish())) for i in range(30)]
    e = Engine(spark.createDataFrame(docs, "doc_id long, content binary"))
    found = cut(glyphs(e), "test")
    order = lambda df, *by: [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.orderBy("doc_id", *by).collect()]
    want = order(e.table("glyph_runs").select("doc_id", "font_num", "code", "x", "y", "advance", "seq", "pos"), "seq", "pos")
    got = order(origins(found).select("doc_id", "font_num", "code", "x", "y", "advance", "seq", "pos"), "seq", "pos")
    assert len(want) > 500 and [r[:6] for r in got] == [r[:6] for r in want]
    want = order(e.features(("text",)).select("doc_id", "bounds.x", "bounds.y", "bounds.width", "bounds.height", "text.text", "seq"), "seq")
    boxes = runs(found, e.table("fonts"))
    got = order(boxes.select("doc_id", "bounds.x", "bounds.y", "bounds.width", "bounds.height", F.decode("bytes", "ISO-8859-1"), "seq"), "seq")
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert glyphs(Engine(spark.createDataFrame([], "doc_id long, content binary"))).collect() == []


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("Broadcast")


def test_tables_of_documents_are_not_broadcast(spark):
    """Thousands of like documents take few bytes in a file: that says nothing of what their rows take in the driver."""
    from vellum import synth
    from vellum.operators.layouts import dereference
    from vellum.plans.cut import cut
    from vellum.plans.tables import Engine

    e = Engine(spark.createDataFrame([(k, bytearray(synth.one_page(b"", extra={5: b"6 0 R", 6: b"%d" % k}).finish())) for k in range(3)], "doc_id long, content binary"))
    out = dereference(e.table("objects").where("num = 5").select("doc_id", "ref"), e.table("objects"), hops=2)
    assert joins(out) == (2, 0)
    parsed = cut(e.bundle(objects={"columns": ("num", "kind")}, headers={"columns": ("version",)}), "parsed")
    rows = lambda name: parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    assert joins(rows("objects").join(rows("headers"), "doc_id")) == (1, 0)
    assert sorted((r["doc_id"], r["value"]) for r in out.collect()) == [(k, '{"t": "integer", "v": %d}' % k) for k in range(3)]


def test_regions_are_not_broadcast(spark):
    from vellum.operators.hits import hits

    features = spark.range(4).selectExpr("id as doc_id", "0 as page_index", "named_struct('x', 1D, 'y', 1D, 'width', 2D, 'height', 2D) as bounds")
    regions = spark.range(4).selectExpr("id as doc_id", "0 as page_index", "7 as region", "named_struct('x', 2D, 'y', 2D, 'width', 5D, 'height', 5D) as rect")
    out = hits(features, regions)
    assert joins(out) == (3, 0) and sorted((r["doc_id"], r["region"]) for r in out.collect()) == [(k, 7) for k in range(4)]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file of one row group and many splits has its rows in one of them, until they are dealt out."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from vellum.queries import dealt

    pq.write_table(pa.table({"a": list(range(5000))}), f"{tmp_path}/t.parquet", row_group_size=5000, use_dictionary=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t.parquet")
        assert rows.rdd.getNumPartitions() > 6
        assert dealt(rows).groupBy(F.spark_partition_id()).count().count() == max(6, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sections_that_follow_each_other_need_no_doubling(spark, monkeypatch):
    """a window orders them; of the others only their own documents are doubled."""
    from vellum.operators import chains

    rows = [(k, i, i - 1 if i else None, None) for k in range(30) for i in range(20)]
    headers = spark.createDataFrame([(k, 19, 2000) for k in range(32)], "doc_id long, xref_start long, xref_end long")
    schema = "doc_id long, at long, prev long, hybrid long"
    asked = []
    own = chains._by_doubling
    monkeypatch.setattr(chains, "_by_doubling", lambda sections, h: asked.append({r["doc_id"] for r in sections.collect()}) or own(sections, h))
    plain = {(r["doc_id"], r["at"]): r["section_ord"] for r in chains.section_order(spark.createDataFrame(rows, schema), headers).collect()}
    assert plain == {(k, i): 19 - i for k in range(30) for i in range(20)} and not asked
    odd = [(30, 19, 5, None), (30, 5, 7, None), (30, 7, None, None), (31, 19, 3, None)]
    mixed = {(r["doc_id"], r["at"]): r["section_ord"] for r in chains.section_order(spark.createDataFrame(rows + odd, schema), headers).collect()}
    assert mixed == plain | {(30, 19): 0, (30, 5): 1, (30, 7): 2, (31, 19): 0} and asked == [{30, 31}]


def test_entries_of_a_section():
    """the entries of one section, without a look at all others."""
    from vellum import synth
    from vellum.core.document import Document

    w = synth.one_page(b"")
    w.add(b"0", 5)
    data = [w.finish()] + [w.update({5: b"%d" % k}) for k in range(1, 5)]
    w = synth.one_page(b"")
    w.add(b"0", 5)
    w.finish()
    for k in range(1, 5):
        w.append({5: b"%d" % k})
    assert bytes(w.out) == data[-1]
    doc = Document(data[-1])

    class Once(list):
        def __iter__(self):
            raise AssertionError("all sections")

    want = [[e for e in doc.xref_entries() if e[0] == k] for k in range(5)]
    doc.sections = Once(doc.sections)
    assert [list(doc.xref_entries(k)) for k in range(5)] == want and len(want[4]) == 5


def test_steps_of_a_string_are_made_once(spark):
    """a number for each byte and codespace, not for each of them and each code that is found."""
    df = spark.createDataFrame([(bytearray(b"A\x81\x40" * 700), [(0, 1, 0x20, 0x7E), (1, 2, 0x8140, 0x9FFC)])], "b binary, spaces array<struct<pos:int,bytes:int,lo:bigint,hi:bigint>>")
    got = df.select(code_steps(F.col("b"), F.col("spaces")).alias("c"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("conv(") == 1
    assert [(c["at"], c["bytes"], c["code"]) for c in got.first()["c"]] == [x for i in range(700) for x in ((3 * i, 1, 0x41), (3 * i + 1, 2, 0x8140))]


def tree_file(kids, pages=(3, 4, 5, 6), extra=None):
    """kids: inner nodes by their numbers, 2 is the root."""
    from vellum import synth

    w = synth.Writer()
    w.add(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
    for n, own in kids.items():
        w.add(b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in own), n)
    for n in pages:
        w.add(b"<< /Type /Page >>", n)
    for n, body in (extra or {}).items():
        w.add(body, n)
    return w


def test_page_tree_agrees_with_the_walk(spark):
    """Nodes of several depths, updates, and what is no tree: circles, a page with kids, kids that are no array, none, or of no kind."""
    from vellum.operators.page_tree import flatten
    from vellum.plans.tables import Engine

    newer = tree_file({2: (3, 4), 10: (6,)})
    newer.finish()
    files = [
        tree_file({2: (10, 3, 11, 3), 10: (4, 5), 11: (12,), 12: (6, 4)}).finish(),
        tree_file({2: (3, 10), 10: (4, 5, 11, 2, 2), 11: (6, 10, 2)}).finish(),
        tree_file({2: (3, 4)}, (4, 5), {3: b"<< /Type /Page /Kids [5 0 R] >>"}).finish(),
        tree_file({}, (3,), {2: b"<< /Type /Pages /Kids << /A 3 0 R >> >>"}).finish(),
        tree_file({2: (3, 99)}).finish(),
        tree_file({2: (3, 7)}, extra={7: b"<< /Kids [4 0 R] >>"}).finish(),
        tree_file({2: tuple(range(30, 3, -1))}, range(4, 31)).finish(),
        newer.update({2: b"<< /Type /Pages /Kids [5 0 R 10 0 R] >>"}),
        tree_file({2: ()}).finish(),
        b"junk",
        None,
    ]
    e = Engine(spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary"))
    want = sorted(tuple(r) for r in e.table("pages", columns=("page_index", "num", "gen", "path")).collect())
    assert [sum(r[0] == k for r in want) for k in range(11)] == [6, 4, 2, 0, 1, 1, 27, 2, 0, 0, 0]
    needed = {"columns": ("num", "gen", "revision", "path", "kind", "s", "ref"), "latest": True, "depth": 2, "keys": ("Type", "Kids", "Pages")}
    for args in ({}, needed):
        assert sorted(tuple(r) for r in flatten(spark, e.table("object_nodes", **args)).collect()) == want
    chain = tree_file({2: (3, 10), 10: (4, 11), 11: (5, 12), 12: (6,)}).finish()
    nodes = Engine(spark.createDataFrame([(7, chain)], "doc_id long, content binary")).table("object_nodes")
    assert [sorted(r["num"] for r in flatten(spark, nodes, depth).collect()) for depth in (1, 3, 4, 64)] == [[3], [3, 4, 5], [3, 4, 5, 6], [3, 4, 5, 6]]


def test_page_tree_of_more_rows_than_a_recursive_query_has(spark, sf_dir):
    """The bound stands for Spark's million."""
    from vellum.queries import QUERIES

    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert QUERIES["page_tree_recursive"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count() > 50
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
