"""Tables of collections: schemas, nulls, errors, SQL, streams."""

from pyspark.sql import functions as F

from vellum import synth
from vellum.plans.tables import SCHEMAS, Engine


def docs(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id long, content binary")


def test_every_table_takes_any_bytes(spark):
    e = Engine(docs(spark, None, b"", b"junk", synth.one_page(b"(x) Tj").finish()))
    for name in SCHEMAS:
        rows = e.table(name).collect()
        assert e.table(name).columns[0] == "doc_id" and isinstance(rows, list)
    errors = {(r["doc_id"], r["failure"]) for r in e.table("parse_errors").collect()}
    assert {(0, "headerNotFound"), (1, "headerNotFound"), (2, "headerNotFound")} <= errors
    assert Engine(docs(spark).limit(0)).features().count() == 0


def test_reading_binary_files(spark, tmp_path):
    from vellum.plans.tables import open_engine

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(synth.one_page(b"BT (t%d) Tj ET" % i).finish())
    (tmp_path / "in" / "no.txt").write_bytes(b"x")
    e = open_engine(spark, str(tmp_path / "in"))
    assert sorted(r[0] for r in e.features(("text",)).select("text.text").collect()) == ["t0", "t1", "t2"]
    assert "content" not in e.docs.select("doc_id")._jdf.queryExecution().executedPlan().toString()


def test_writing_files(spark, tmp_path):
    from vellum.plans.tables import open_engine
    from vellum.sources.pdf import write_files

    files = docs(spark, *[synth.one_page(b"BT (w%d) Tj ET" % i).finish() for i in range(5)], None)
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        told = write_files(files, path)
        assert sorted((r["doc_id"], r["name"]) for r in told.collect()) == [(i, f"{i}.pdf") for i in range(5)]
        assert sorted(r[0] for r in open_engine(spark, path).features(("text",)).select("text.text").collect()) == [f"w{i}" for i in range(5)]


def test_columns_rows_and_bundles(spark):
    e = Engine(docs(spark, synth.one_page(b"q 1 w 2 w BT (a) Tj ET Q").finish(), None))
    assert e.table("operators", columns=("seq", "op"), ops=("w", "Q")).collect() == [(0, 1, "w"), (0, 2, "w"), (0, 6, "Q")]
    assert e.table("operators", columns=("op",), most=2).collect() == [(0, "q"), (0, "w")] and e.table("operators", pages=(1,)).count() == 0
    assert e.table("objects", columns=("num",), nums=(3, 4), latest=True).collect() == [(0, 3), (0, 4)]
    both = e.bundle(pages={"columns": ("page_index",)}, features={"mask": 4}, object_layouts={})
    a, b = both.orderBy("doc_id").collect()
    assert (a["pages"], len(a["features"]), len(a["object_layouts"])) == ([(0,)], 1, 4) and b["pages"] == b["features"] == []
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_layouts_agree_with_their_relational_form(spark):
    from vellum.operators.layouts import object_layouts

    w = synth.one_page(b"", extra={5: b"1", 6: b"<< >>"})
    w.finish()
    packed = synth.one_page(b"", extra={5: b"(x)"}).finish_packed()
    e = Engine(docs(spark, w.update({5: b"2"}), packed, synth.one_page(b"", extra={5: b"7"}).finish(xref=False)))
    cols = ["doc_id", "num", "gen", "revision", "storage"]
    want = object_layouts(e.table("xref_entries"), e.table("headers")).select(*cols).collect()
    assert sorted(map(repr, e.table("object_layouts").select(*cols).collect())) == sorted(map(repr, want)) and len(want) > 12


def test_deep_forms_are_an_error(spark):
    forms = {n: synth.stream(b"/F Do", b"/Subtype /Form /BBox [0 0 1 1] /Resources << /XObject << /F %d 0 R >> >>" % (n + 1)) for n in range(5, 80)}
    e = Engine(docs(spark, synth.one_page(b"/F Do", b"/XObject << /F 5 0 R >>", extra=forms).finish()))
    assert [r[0] for r in e.table("parse_errors").select("failure").collect()] == ["nestedTooDeeply"]


def test_the_end_is_found_behind_long_lines(spark):
    data = synth.one_page(b"BT (x) Tj ET").finish()
    e = Engine(docs(spark, data + b"\n" * 9000, data.replace(b"startxref", b"%" + b"x" * 5000 + b"\nstartxref")))
    assert e.features(("text",)).count() == 2 and e.table("headers").where("recovered").count() == 0


def test_views_and_udtfs(spark):
    from vellum.functions.udtf import register

    d = docs(spark, synth.one_page(b"BT (hello) Tj ET").finish())
    Engine(d).register()
    register(spark)
    d.createOrReplaceTempView("d")
    assert spark.sql("SELECT text.text FROM pdf_features WHERE kind = 'text'").first()[0] == "hello"
    assert spark.sql("SELECT count(*) FROM pdf_object_layouts").first()[0] == 4
    assert [r[0] for r in spark.sql("SELECT f.op FROM d, LATERAL pdf_operators(content) f ORDER BY f.seq").collect()] == ["BT", "Tj", "ET"]
    assert spark.sql("SELECT f.kind FROM d, LATERAL pdf_features(content, 4) f").first()[0] == "text"
    assert spark.sql("SELECT pdf_text(unhex('9394'))").first()[0] == "ﬁﬂ"
    assert spark.sql("SELECT pdf_function_eval('{2 mul}', array(0D, 1D), array(0D, 9D), array(0.25D))").first()[0] == [0.5]
    assert bytes(spark.sql("SELECT pdf_decode_stream(unhex('01010101'), array('Nope'), 1, 1, 8, 1)").first()[0] or b"none") == b"none"


def test_stream_of_files(spark, tmp_path):
    from vellum.streaming.ingest import arrivals, stream_pdfs, write_tables

    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(synth.one_page(b"BT (t%d) Tj ET" % i).finish())
    s = stream_pdfs(spark, str(tmp_path / "in"), per_trigger=2)
    assert s.isStreaming and arrivals(s).isStreaming
    write_tables(s, ["features", "pages"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "features")).count() == 4
    (tmp_path / "in" / "9.pdf").write_bytes(synth.one_page(b"BT (late) Tj ET").finish())
    write_tables(s, ["features", "pages"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "features")).count() == 5


def test_parsing_does_not_shuffle(spark):
    plan = Engine(docs(spark, b"")).features().where("kind = 'text'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_functions_stay_in_codegen(spark):
    from vellum.core.functions import Function, parse_program
    from vellum.functions.pdf_functions import compile_function

    f = Function("calculator", (0.0, 1.0), (0.0, 1.0), program=parse_program("{dup 0.5 gt {1 exch sub} if}"))
    df = spark.range(11).select(compile_function(f, [F.col("id") / 10])[0].alias("v"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [round(r[0], 6) for r in df.collect()] == [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.4, 0.3, 0.2, 0.1, 0]


def test_images_as_files(spark):
    import struct
    import zlib

    from vellum.sources.images import image_files

    im = lambda extra, data: synth.stream(data, b"/Subtype /Image /Width 2 /Height 1 " + extra)
    w = synth.one_page(b"", extra={5: im(b"/ColorSpace /DeviceGray /BitsPerComponent 8", b"\x01\xff"), 6: im(b"/Filter /DCTDecode", b"\xff\xd8"), 7: im(b"/ColorSpace [/Indexed /DeviceRGB 1 <000000FF8000>] /BitsPerComponent 1", b"\x40")})
    got = {r["num"]: (r["extension"], bytes(r["file"])) for r in image_files(Engine(docs(spark, w.finish()))).collect()}
    assert got[6] == ("jpg", b"\xff\xd8") and got[5][0] == "png" and struct.unpack(">II", got[5][1][16:24]) == (2, 1)
    data = lambda b: zlib.decompress(b[b.index(b"IDAT") + 4 : b.index(b"IEND") - 8])
    assert data(got[5][1]) == b"\0\x01\xff" and data(got[7][1]) == b"\0\0\0\0\xff\x80\0"


def test_files_by_size(spark):
    from vellum.sources.pdf import spread

    docs = spark.createDataFrame([(i, bytearray(b"x" * (5000 if i % 10 == 0 else 10))) for i in range(40)], "doc_id long, content binary")
    parts = spread(docs, 1000).rdd.glom().map(lambda p: [r["doc_id"] for r in p]).collect()
    assert sorted(x for p in parts for x in p) == list(range(40))
    assert all(p == [p[0]] for p in parts if any(x % 10 == 0 for x in p))  # a large one is alone
    assert spread(docs.limit(0)).count() == 0 and spread(docs.where("doc_id % 10 <> 0"), 100).rdd.getNumPartitions() == 4


def test_passwords_in_sql(spark):
    from vellum import synth
    from vellum.functions.udtf import register

    register(spark)
    w = synth.one_page(b"")
    trailer, key = synth.rc4_40(w, b"pdf", b"owner")
    w.objects[4] = synth.stream(synth.arcfour(synth.object_key(key, 4), b"BT /F1 12 Tf (sealed) Tj ET"))
    spark.createDataFrame([(bytearray(w.finish(trailer=trailer)),)], "content binary").createOrReplaceTempView("vellum_sealed")
    text = "SELECT f.text.text FROM vellum_sealed, LATERAL pdf_features(content, 4, {}) f"
    assert [r["text"] for r in spark.sql(text.format("'pdf'")).collect()] == ["sealed"]
    assert spark.sql("SELECT count(*) AS n FROM vellum_sealed, LATERAL pdf_operators(content, 'pdf') o WHERE op = 'Tj'").first()["n"] == 1
    assert [r["failure"] for r in spark.sql("SELECT failure FROM vellum_sealed, LATERAL pdf_errors(content)").collect()][:1] == ["passwordRequired"]
    got = spark.sql("SELECT pdf_text(X'FEFF00410042') AS a, pdf_text(X'EFBBBFC3A9') AS b, pdf_text(X'41A0') AS c, pdf_text(NULL) AS d").first()
    assert (got["a"], got["b"], got["c"], got["d"]) == ("AB", "é", "A₢", None)


def test_decryption_of_many_blocks():
    from vellum import synth
    from vellum.core.crypt import aes_cbc_decrypt

    for key in (bytes(range(16)), bytes(range(32))):
        plain = bytes(i * 7 % 256 for i in range(16 * 50))
        assert aes_cbc_decrypt(key, synth.rijndael_cbc(key, bytes(16), plain), iv=bytes(16), unpad=False) == plain
        assert aes_cbc_decrypt(key, bytes(16), unpad=False) == b""


def test_texts_without_boxes(spark):
    """Text that is not measured is the text that is, empty runs and all."""
    from vellum import synth
    from vellum.plans.tables import Engine

    body = b"BT (no font) Tj /F1 12 Tf (a) Tj [(b) -20 () (c)] TJ () Tj [] TJ [5] TJ [()] TJ (d) ' 1 2 (e) \" /F9 3 Tf (f) Tj () Tj ET"
    font = synth.FONT.replace(b"[400", b"[0")
    e = Engine(spark.createDataFrame([(1, bytearray(synth.one_page(body, b"/Font << /F1 5 0 R >>", extra={5: font}).finish()))], "doc_id long, content binary"))
    want = [(r["seq"], r["text"]) for r in e.features(("text",)).orderBy("seq").collect()]
    assert [(r["seq"], r["text"]) for r in e.table("features", columns=("seq", "text"), mask=4).orderBy("seq").collect()] == want and len(want) == 6


def test_jbig2_files(spark):
    from vellum import synth
    from vellum.plans.tables import Engine
    from vellum.sources.images import image_files

    image = synth.stream(b"page", b"/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /JBIG2Decode /DecodeParms << /JBIG2Globals 7 0 R >>")
    data = synth.one_page(b"", extra={6: image, 7: synth.stream(b"shared", flate=True), 8: image.replace(b"/JBIG2Globals 7 0 R", b"")}).finish()
    rows = image_files(Engine(spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary"))).orderBy("num").collect()
    assert [(r["num"], r["extension"], bytes(r["file"])[13:]) for r in rows] == [(6, "jb2", b"sharedpage"), (8, "jb2", b"page")] and bytes(rows[0]["file"])[:4] == b"\x97JB2"


def test_blocks_beyond_those_decrypted_at_once(monkeypatch):
    """Keys are expanded once; blocks meet across the parts in which they are decrypted."""
    import random

    from vellum import synth
    from vellum.core import crypt

    rng = random.Random(5)
    monkeypatch.setattr(crypt, "_BLOCKS", 3)
    for n in (16, 32):
        key, iv = rng.randbytes(n), rng.randbytes(16)
        for blocks in (1, 2, 3, 4, 7):
            plain = rng.randbytes(16 * blocks)
            assert crypt.aes_cbc_decrypt(key, synth.rijndael_cbc(key, iv, plain), iv=iv, unpad=False) == plain
        assert crypt._schedule(key) is crypt._schedule(key)


def test_rows_are_held_by_bytes():
    """Batches of rows for Python are cut by rows and by bytes; none is lost."""
    import pyarrow as pa

    from vellum.plans.tables import HELD, slices

    small = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["a"])
    large = pa.RecordBatch.from_arrays([pa.array([b"x" * (HELD // 4)] * 10 + [b"y" * 3 * HELD])], names=["a"])
    assert [p.num_rows for p in slices(small)] == [256, 256, 256, 232]
    parts = list(slices(large))
    assert max(p.num_rows for p in parts) <= 4 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([large]))
    assert list(slices(small.slice(0, 0))) == []


def test_large_files_leave_python_before_many_rows(spark):
    """Rows of files of more than HELD bytes are not kept until there are BATCH of them."""
    from vellum import synth
    from vellum.plans.tables import HELD, Engine

    body = b"%" + b"x" * (HELD // 2) + b"\n1 w"
    docs = spark.createDataFrame([(k, bytearray(synth.one_page(body).finish())) for k in range(5)], "doc_id long, content binary").coalesce(1)
    found = Engine(docs).table("operators", columns=("op", "nums"))
    sizes = found.mapInArrow(lambda batches: (b.select(["doc_id"]) for b in batches), "doc_id long")
    assert sorted(r["doc_id"] for r in sizes.collect()) == list(range(5))
    assert [(r["op"], r["nums"]) for r in found.collect()] == [("w", [1.0])] * 5
