"""Queries that walk through the format: every content operator, graphics state, predictor, encoding, colour and calculator word.

Like vellum.queries: files are written from the rows of a table, read by the engine, and the SQL says what must come out.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import synth
from vellum.functions import geometry as G
from vellum.plans.cut import cut
from vellum.plans.tables import Engine
from vellum.queries import F1, FONT, IM, IMAGE, _function, dealt, num, query, read, write_pdfs


def _nations(spark, sf_dir, make) -> Engine:
    return Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", lambda r: make(r["n_nationkey"], r["n_name"])))


def _suppliers(spark, sf_dir, make, **args) -> Engine:
    return Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", lambda r: make(r["s_suppkey"], r["s_name"])), **args)


def _values(rows: list[tuple]) -> str:
    """SQL VALUES of numbers and strings."""
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


# ---- content operators ----------------------------------------------------------------------------------------------

#: (operator, numbers before it, what else it takes); the numbers of the i-th document are i + 1, i + 2, ...
CONTENT = [
    ("q", 0, ""), ("cm", 6, ""), ("w", 1, ""), ("J", 1, ""), ("j", 1, ""), ("M", 1, ""), ("d", 3, "dash"), ("ri", 0, "name"), ("i", 1, ""), ("gs", 0, "name"),
    ("m", 2, ""), ("l", 2, ""), ("c", 6, ""), ("v", 4, ""), ("y", 4, ""), ("h", 0, ""), ("re", 4, ""), ("W", 0, ""), ("n", 0, ""), ("S", 0, ""), ("s", 0, ""), ("f", 0, ""),
    ("F", 0, ""), ("f*", 0, ""), ("B", 0, ""), ("B*", 0, ""), ("b", 0, ""), ("b*", 0, ""), ("W*", 0, ""), ("BT", 0, ""), ("Tc", 1, ""), ("Tw", 1, ""), ("Tz", 1, ""),
    ("TL", 1, ""), ("Tf", 1, "name"), ("Tr", 1, ""), ("Ts", 1, ""), ("Td", 2, ""), ("TD", 2, ""), ("Tm", 6, ""), ("T*", 0, ""), ("Tj", 0, "text"), ("TJ", 0, "parts"), ("'", 0, "text"),
    ('"', 2, "text"), ("ET", 0, ""), ("d0", 0, ""), ("d1", 0, ""), ("CS", 0, "name"), ("cs", 0, "name"), ("SC", 2, ""), ("sc", 3, ""), ("SCN", 1, ""), ("scn", 4, ""), ("G", 1, ""),
    ("g", 1, ""), ("RG", 3, ""), ("rg", 3, ""), ("K", 4, ""), ("k", 4, ""), ("sh", 0, "name"), ("BI", 0, ""), ("ID", 0, "inline"), ("EI", 0, ""), ("Do", 0, "name"), ("MP", 0, "name"),
    ("DP", 0, "props"), ("BMC", 0, "name"), ("BDC", 0, "props"), ("EMC", 0, ""), ("BX", 0, ""), ("EX", 0, ""), ("Q", 0, ""),
]


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(seq AS INTEGER) AS seq, op,
CASE other WHEN 'dash' THEN (k + 3) || ' ' || (k + 1) || ' ' || (k + 2) ELSE CASE op WHEN '"' THEN (k + 2) || ' ' || (k + 1) ELSE array_to_string([k + i FOR i IN range(1, n + 1)], ' ') END END AS nums,
CASE WHEN other IN ('name', 'props') THEN 'N' || k ELSE '' END AS name, CASE other WHEN 'text' THEN n_name WHEN 'inline' THEN 'x' || k ELSE '' END AS text,
CASE other WHEN 'parts' THEN n_name || '|-' || (k + 1) || '|!' ELSE '' END AS parts,
CASE other WHEN 'props' THEN '' || k WHEN 'inline' THEN '' || (k + 1) ELSE '' END AS props
FROM (SELECT n_nationkey, n_name, n_nationkey AS k FROM nation), {_values([(i, *x) for i, x in enumerate(CONTENT)])} v(seq, op, n, other)""")
def content_operators(spark, sf_dir):
    def make(k, name):
        said, body = synth.literal(name.encode()), []
        for op, n, other in CONTENT:
            numbers = [b"%d" % (k + i) for i in range(1, n + 1)]
            if op in ("BI", "EI"):
                continue
            before = {
                "": numbers, "dash": [b"[", *numbers[:2], b"]", *numbers[2:]], "name": [b"/N%d" % k, *numbers], "text": [*numbers, said], "parts": [b"[%s -%d (!)]" % (said, k + 1)],
                "props": [b"/N%d << /K %d >>" % (k, k)], "inline": [b"BI /W %d" % (k + 1)],
            }[other]
            body.append(b" ".join([*before, op.encode()]) + (b" x%d\nEI" % k if op == "ID" else b""))
        return synth.one_page(b"\n".join(body)).finish()

    ops = _nations(spark, sf_dir, make).table("operators")
    whole = lambda x: x.cast("int").cast("string")
    part = lambda x: F.coalesce(F.decode(x["text"], "UTF-8"), whole(x["offset"]))
    json = lambda *p: F.coalesce(*[F.get_json_object("props", f"$.v.{x}.v") for x in p], F.lit(""))
    return ops.select(
        "doc_id", "seq", "op", F.array_join(F.transform("nums", whole), " ").alias("nums"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.decode("bytes", "UTF-8"), F.lit("")).alias("text"),
        F.coalesce(F.array_join(F.transform("tj", part), "|"), F.lit("")).alias("parts"), json("K", "W", "Width").alias("props"),
    )


#: Painting operators with the rows that each draws: (operator, verb, path is closed by the operator).
PAINTING = [("S", "stroke", 0), ("s", "stroke", 1), ("f", "fill", 0), ("F", "fill", 0), ("f*", "eofill", 0), ("B", "fill", 0), ("B", "stroke", 0), ("B*", "eofill", 0), ("B*", "stroke", 0), ("b", "fill", 1), ("b", "stroke", 1), ("b*", "eofill", 1), ("b*", "stroke", 1)]


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, verb, 'm ' || k || ' 0.25 l ' || (k + 9) || ' 0 c 1 2 3 4 5 6 c 5 6 7 8 9 ' || k || ' c 1 1 2 3 2 3 h l 4 4' || CASE closed WHEN 1 THEN ' h' ELSE '' END AS path FROM (SELECT *, n_nationkey AS k FROM nation), {_values([(i, *x) for i, x in enumerate(PAINTING)])} v(i, op, verb, closed)""")
def path_painting(spark, sf_dir):
    def make(k, _):
        path = b"%d 0.25 m %d 0 l 1 2 3 4 5 6 c 7 8 9 %d v 1 1 2 3 y h 4 4 l " % (k, k + 9, k)
        return synth.one_page(b"\n".join(path + op.encode() for op in [*dict.fromkeys(x[0] for x in PAINTING), "n"])).finish()

    return _nations(spark, sf_dir, make).table("display_list", columns=("seq", "verb", "path"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, verb, CAST(clips AS INTEGER) AS clips FROM nation, (VALUES ('clip', 1), ('eoclip', 2), ('fill', 2), ('stroke', 0)) v(verb, clips)")
def clip_depth(spark, sf_dir):
    make = lambda k, _: synth.one_page(b"q 0 0 %d 9 re W n 0 0 5 5 re W* n 0 0 1 1 re f Q 0 0 2 2 re S" % (k + 1)).finish()
    return _nations(spark, sf_dir, make).table("display_list", columns=("verb", "clips"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, verb, space, round(red, 6)::DOUBLE AS red, round(green, 6)::DOUBLE AS green, line_width::DOUBLE AS line_width FROM (SELECT *, n_nationkey / 25.0 AS t FROM nation), LATERAL (VALUES
('stroke', 'DeviceGray', t, t, n_nationkey + 1), ('fill', 'DeviceRGB', t, 0.5, n_nationkey + 1), ('stroke', 'DeviceCMYK', 1 - t, 1.0, n_nationkey + 2), ('stroke', 'DeviceRGB', 0.25, t, n_nationkey + 2)) v(verb, space, red, green, line_width)""")
def stroke_colours(spark, sf_dir):
    def make(k, _):
        t = num(k / 25)
        return synth.one_page(b"%d w %s G 0 0 m 1 1 l S %s 0.5 0 rg 0 0 1 1 re f %d w %s 0 0 0 K 0 0 m 1 1 l S /DeviceRGB CS 0.25 %s 0 SC 0 0 m 1 1 l S" % (k + 1, t, t, k + 2, t, t)).finish()

    d = _nations(spark, sf_dir, make).table("display_list", columns=("verb", "space", "rgb", "line_width"))
    return d.select("doc_id", "verb", "space", F.round(F.col("rgb")[0], 6).alias("red"), F.round(F.col("rgb")[1], 6).alias("green"), "line_width")


# ---- text -----------------------------------------------------------------------------------------------------------

WIDTHS_SQL = "list_sum([400 + 10 * (ascii(substr({0}, CAST(i AS BIGINT), 1)) % 16) FOR i IN range(1, length({0}) + 1)]) / 1000.0"


@query(f"""SELECT s_suppkey AS doc_id, t AS text, round((12 * {WIDTHS_SQL.format("t")} + 1.5 * length(t) + 3) * 0.5, 6)::DOUBLE AS width, round(500 - 12 * 0.2, 6)::DOUBLE AS y FROM (SELECT *, s_name || ' z' AS t FROM supplier)""")
def text_spacing(spark, sf_dir):
    """Character spacing for each code, word spacing for the blank, then the horizontal scale."""
    make = lambda k, name: synth.one_page(b"BT /F1 12 Tf 1.5 Tc 3 Tw 50 Tz 100 500 Td %s Tj ET" % synth.literal(name.encode() + b" z"), F1, extra=FONT).finish()
    f = _measured(_suppliers(spark, sf_dir, make))
    return f.select("doc_id", "text", F.round("bounds.width", 6).alias("width"), F.round("bounds.y", 6).alias("y"))


def _measured(e: Engine) -> DataFrame:
    """Text operators with their texts and boxes, by windows over the glyphs; the files are written once."""
    from vellum.functions.text import pdf_text
    from vellum.operators.measure import glyphs, runs

    e = Engine(cut(e.docs, "files"))
    return runs(glyphs(e), e.table("fonts", columns=("num", "gen", "up", "down"))).withColumn("text", pdf_text(F.col("bytes")))


@query(f"""SELECT s_suppkey AS doc_id, s_name || 'xy' AS text, 50.0::DOUBLE AS x, round(10 * ({WIDTHS_SQL.format("s_name")} + 0.25 + {WIDTHS_SQL.format("'xy'")}), 6)::DOUBLE AS width FROM supplier""")
def tj_bounds(spark, sf_dir):
    """The parts of a TJ are one run, which reaches from the first to the last."""
    make = lambda k, name: synth.one_page(b"BT /F1 10 Tf 50 60 Td [%s -250 (xy)] TJ ET" % synth.literal(name.encode()), F1, extra=FONT).finish()
    return _measured(_suppliers(spark, sf_dir, make)).select("doc_id", "text", "bounds.x", F.round("bounds.width", 6).alias("width"))


@query("SELECT s_suppkey AS doc_id, s_name AS text, CAST(s_suppkey % 8 AS VARCHAR) AS mode FROM supplier")
def text_modes(spark, sf_dir):
    make = lambda k, name: synth.one_page(b"BT /F1 12 Tf %d Tr %s Tj ET" % (k % 8, synth.literal(name.encode())), F1, extra=FONT).finish()
    d = _suppliers(spark, sf_dir, make).table("display_list", columns=("verb", "what"))
    return d.select("doc_id", F.col("what").alias("text"), F.replace("verb", F.lit("text"), F.lit("")).alias("mode"))


@query("SELECT s_suppkey AS doc_id, s_name || 'AB@' AS text FROM supplier")
def comments_and_hex(spark, sf_dir):
    """Comments are blanks; an odd last digit of a hexadecimal string is followed by 0; empty runs are no features."""
    make = lambda k, name: synth.one_page(b"BT %% (no) Tj\n/F1 12 Tf () Tj [%s <41 4\n2 4>] TJ %%%%EOF\nET" % synth.literal(name.encode()), F1, extra=FONT).finish()
    return _suppliers(spark, sf_dir, make).features(("text",)).select("doc_id", F.col("text.text").alias("text"))


@query("SELECT s_suppkey AS doc_id, CAST(ord AS INTEGER) AS ord, num::BIGINT AS num, data, s_name AS text FROM supplier, (VALUES (0, 4, 'BT /F1 9 Tf '), (1, 6, NULL), (2, 7, ' Tj ET')) v(ord, num, d), LATERAL (SELECT coalesce(d, '(' || s_name || ')') AS data)")
def content_in_parts(spark, sf_dir):
    """A page's streams are one content, whatever the cuts."""

    def make(k, name):
        w = synth.one_page(b"BT /F1 9 Tf ", F1, b"/MediaBox [0 0 9 9]", FONT)
        w.add(w.objects[3].replace(b"/Contents 4 0 R", b"/Contents [4 0 R 6 0 R 7 0 R]"), 3)
        w.add(synth.stream(synth.literal(name.encode())), 6)
        w.add(synth.stream(b" Tj ET", flate=True), 7)
        return w.finish()

    both = _suppliers(spark, sf_dir, make).bundle(content_streams={"columns": ("ord", "num", "data")}, features={"mask": 4, "columns": ("text",)})
    out = both.select("doc_id", F.inline("content_streams"), F.col("features")[0]["text"]["text"].alias("text"))
    return out.select("doc_id", "ord", "num", F.decode("data", "UTF-8").alias("data"), "text")


@query("SELECT c_custkey AS doc_id, c_name || '€' AS utf16, c_name || 'ß' AS utf8, (256 * (c_custkey % 200) + 7)::BIGINT AS code FROM customer")
def text_strings(spark, sf_dir):
    """Text strings with a byte order mark, and codes of several bytes."""
    from vellum.functions.text import big_endian, pdf_text

    marked = lambda mark, s, kind: pdf_text(F.concat(F.lit(mark), F.encode(F.concat("c_name", F.lit(s)), kind)))
    code = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 200), 2, "0"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marked(b"\xfe\xff", "€", "UTF-16BE").alias("utf16"), marked(b"\xef\xbb\xbf", "ß", "UTF-8").alias("utf8"), big_endian(F.concat(code, F.lit(b"\x07"))).cast("long").alias("code"))


# ---- fonts ----------------------------------------------------------------------------------------------------------

#: Codes of the seven tables with their glyphs, from the annexes of the format's standard.
GLYPHS = [
    ("StandardEncoding", 65, "A"), ("StandardEncoding", 39, "quoteright"), ("StandardEncoding", 174, "fi"), ("StandardEncoding", 225, "AE"), ("StandardEncoding", 251, "germandbls"), ("StandardEncoding", 207, "caron"),
    ("WinAnsiEncoding", 128, "Euro"), ("WinAnsiEncoding", 233, "eacute"), ("WinAnsiEncoding", 39, "quotesingle"), ("WinAnsiEncoding", 149, "bullet"), ("WinAnsiEncoding", 255, "ydieresis"),
    ("MacRomanEncoding", 128, "Adieresis"), ("MacRomanEncoding", 142, "eacute"), ("MacRomanEncoding", 222, "fi"), ("MacRomanEncoding", 165, "bullet"), ("MacRomanEncoding", 216, "ydieresis"),
    ("ExpertEncoding", 48, "zerooldstyle"), ("ExpertEncoding", 86, "ff"), ("ExpertEncoding", 97, "Asmall"),
    ("MacExpertEncoding", 48, "zerooldstyle"), ("MacExpertEncoding", 86, "ff"), ("MacExpertEncoding", 97, "Asmall"), ("MacExpertEncoding", 71, "onequarter"),
    ("SymbolEncoding", 97, "alpha"), ("SymbolEncoding", 87, "Omega"), ("SymbolEncoding", 34, "universal"), ("SymbolEncoding", 242, "integral"),
    ("ZapfDingbatsEncoding", 33, "a1"), ("ZapfDingbatsEncoding", 97, "a60"), ("ZapfDingbatsEncoding", 254, "a191"), ("ZapfDingbatsEncoding", 172, "a120"),
]


@query("SELECT s_suppkey AS doc_id, 'Type1' AS subtype, 'Sub+' || s_suppkey AS base_font, (700 + s_suppkey % 50)::DOUBLE AS ascent, (-200)::DOUBLE AS descent, 650::DOUBLE AS cap_height, (-12)::DOUBLE AS italic, 1010::DOUBLE AS width FROM supplier")
def font_descriptors(spark, sf_dir):
    def make(k, _):
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Sub+%d /FontDescriptor 6 0 R >>" % k
        return synth.one_page(b"", F1, extra={5: font, 6: b"<< /Type /FontDescriptor /FontBBox [-10 -200 1000 900] /Ascent %d /Descent -200 /CapHeight 650 /ItalicAngle -12 >>" % (700 + k % 50)}).finish()

    f = _suppliers(spark, sf_dir, make).table("fonts", columns=("subtype", "base_font", "ascent", "descent", "cap_height", "italic", "bbox"))
    return f.select("doc_id", "subtype", "base_font", "ascent", "descent", "cap_height", "italic", F.col("bbox.width").alias("width"))


@query("SELECT s_suppkey AS doc_id, 'Type3' AS subtype, round(1 / (500.0 + s_suppkey % 9), 9)::DOUBLE AS a FROM supplier")
def font_matrices(spark, sf_dir):
    def make(k, _):
        font = b"<< /Type /Font /Subtype /Type3 /FontBBox [0 0 9 9] /FontMatrix [%s 0 0 0.001 0 0] /CharProcs << >> /Encoding << /Differences [] >> /FirstChar 0 /LastChar 0 /Widths [9] >>" % num(1 / (500 + k % 9))
        return synth.one_page(b"", F1, extra={5: font}).finish()

    return _suppliers(spark, sf_dir, make).table("fonts", columns=("subtype", "matrix")).select("doc_id", "subtype", F.round("matrix.a", 9).alias("a"))


@query(f"""SELECT s_suppkey AS doc_id, CAST(j - 1 AS INTEGER) AS pos, ascii(substr(s_name, j, 1))::BIGINT AS code, CASE substr(s_name, j, 1) WHEN 'S' THEN 'big' WHEN '#' THEN 'numbersign' WHEN 'u' THEN 'u' END AS glyph,
round(100 + 12 * coalesce({WIDTHS_SQL.format("substr(s_name, 1, j - 1)")}, 0) + 2 * (j - 1), 6)::DOUBLE AS x, 503.0::DOUBLE AS y FROM (SELECT s_suppkey, s_name, unnest(range(1, length(s_name) + 1)) AS j FROM supplier) WHERE substr(s_name, j, 1) IN ('S', '#', 'u')""")
def glyph_runs_simple(spark, sf_dir):
    """Names by differences and base encoding; origins with rise and character spacing."""
    font = {5: synth.FONT.replace(b"/Encoding /WinAnsiEncoding", b"/Encoding << /BaseEncoding /WinAnsiEncoding /Differences [83 /big] >>")}
    make = lambda k, name: synth.one_page(b"BT /F1 12 Tf 2 Tc 3 Ts 100 500 Td %s Tj ET" % synth.literal(name.encode()), F1, extra=font).finish()
    from vellum.operators.measure import glyphs, origins
    from vellum.operators.text import base_encodings, glyph_names

    e = Engine(cut(_suppliers(spark, sf_dir, make).docs, "files"))
    fonts = e.table("fonts", columns=("num", "gen", "encoding"))
    g = origins(glyphs(e)).where("code in (83, 35, 117)").select("doc_id", F.col("font_num").alias("num"), F.col("font_gen").alias("gen"), "pos", "code", "x", "y").join(fonts, ["doc_id", "num", "gen"])
    g = glyph_names(g, e.table("font_differences"), base_encodings(spark))
    return g.select("doc_id", "pos", F.col("code").cast("long").alias("code"), "glyph", *[F.round(c, 6).alias(c) for c in ("x", "y")])


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS pos, (i + 1)::BIGINT AS code, (n_nationkey + 3 * i)::BIGINT AS gid, (20 + 10 * CASE i WHEN 0 THEN 0 WHEN 1 THEN 0.25 ELSE 0.75 END)::DOUBLE AS x FROM nation, range(3) v(i)")
def glyph_runs_composite(spark, sf_dir):
    """Characters to glyphs through the font's map; widths by character."""

    def make(k, _):
        gids = b"\0\0" + b"".join((k + 3 * i).to_bytes(2, "big") for i in range(3))
        kids = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /DW 500 /W [1 [250]] /CIDToGIDMap 7 0 R >>"
        font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [6 0 R] >>"
        return synth.one_page(b"BT /F1 10 Tf 20 20 Td <000100020003> Tj ET", F1, extra={5: font, 6: kids, 7: synth.stream(gids)}).finish()

    return _nations(spark, sf_dir, make).table("glyph_runs", columns=("pos", "code", "gid", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, lo::BIGINT AS lo, hi::BIGINT AS hi, advance::DOUBLE AS advance, x::DOUBLE AS x, y::DOUBLE AS y, 900.0::DOUBLE AS default_y, (-950.0)::DOUBLE AS default_advance
FROM nation, LATERAL (VALUES (1, 1, -800, 250, 772), (2, 2, -700, 260, 600 + n_nationkey), (10, 20, -900, 300, 800)) v(lo, hi, advance, x, y)""")
def vertical_metrics(spark, sf_dir):
    def make(k, _):
        kids = b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /X /DW2 [900 -950] /W2 [1 [-800 250 772 -700 260 %d] 10 20 -900 300 800] >>" % (600 + k)
        return synth.one_page(b"", F1, extra={5: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-V /DescendantFonts [6 0 R] >>", 6: kids}).finish()

    return _nations(spark, sf_dir, make).table("vertical_metrics").drop("num", "gen", "pos")


# ---- graphics state, images and colours -----------------------------------------------------------------------------


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, (k + 0.5)::DOUBLE AS line_width, CAST(k % 3 AS INTEGER) AS line_cap, CAST((k + 1) % 3 AS INTEGER) AS line_join, (k + 1)::DOUBLE AS miter, 3::DOUBLE AS dash_phase, '1 ' || (k + 2) AS dash,
['AbsoluteColorimetric', 'RelativeColorimetric', 'Saturation', 'Perceptual'][k % 4 + 1] AS intent, k % 2 = 0 AS overprint_stroke, k % 2 = 1 AS overprint_fill, CAST(k % 2 AS INTEGER) AS overprint_mode, k::DOUBLE AS flatness, (k / 100.0)::DOUBLE AS smoothness,
true AS stroke_adjust, 'Multiply' AS blend, ['Alpha', 'Luminosity', 'None'][k % 3 + 1] AS smask, (k / 50.0)::DOUBLE AS stroke_alpha, (k / 25.0)::DOUBLE AS fill_alpha, false AS alpha_is_shape, k % 2 = 0 AS text_knockout FROM (SELECT *, n_nationkey AS k FROM nation)""")
def ext_gstate_fields(spark, sf_dir):
    def make(k, _):
        yes = lambda b: b"true" if b else b"false"
        intent = [b"AbsoluteColorimetric", b"RelativeColorimetric", b"Saturation", b"Perceptual"][k % 4]
        mask = [b"<< /S /Alpha >>", b"<< /S /Luminosity >>", b"/None"][k % 3]
        fields = b"/LW %s /LC %d /LJ %d /ML %d /D [[1 %d] 3] /RI /%s /OP %s /op %s /OPM %d /FL %d /SM %s /SA true /BM /Multiply /SMask %s /CA %s /ca %s /AIS false /TK %s"
        values = (num(k + 0.5), k % 3, (k + 1) % 3, k + 1, k + 2, intent, yes(k % 2 == 0), yes(k % 2), k % 2, k, num(k / 100), mask, num(k / 50), num(k / 25), yes(k % 2 == 0))
        return synth.one_page(b"", b"/ExtGState << /G << %s >> >>" % (fields % values)).finish()

    g = _nations(spark, sf_dir, make).table("ext_gstates").drop("page_index", "key")
    return g.withColumns({"dash": F.array_join(F.transform("dash", lambda x: x.cast("int").cast("string")), " "), **{c: F.round(c, 6) for c in ("smoothness", "stroke_alpha", "fill_alpha")}})


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, CASE i WHEN 0 THEN 1 ELSE 2 END AS line_cap, 1 AS line_join, (CASE i WHEN 1 THEN n_nationkey + 2 ELSE 5 END)::DOUBLE AS miter,
CASE i WHEN 1 THEN '2 1' ELSE '3 ' || n_nationkey END AS dash, (CASE i WHEN 1 THEN 2 ELSE 0 END)::DOUBLE AS dash_phase, (CASE i WHEN 1 THEN 7 ELSE 4 END)::DOUBLE AS flatness, CASE i WHEN 1 THEN 'Perceptual' ELSE 'Saturation' END AS intent, CASE i WHEN 1 THEN 'Alpha' END AS smask
FROM nation, range(3) v(i)""".replace("CASE i WHEN 0 THEN 1 ELSE 2 END AS line_cap", "CASE i WHEN 1 THEN 2 ELSE 1 END AS line_cap"))
def gstate_applied(spark, sf_dir):
    """What a graphics state dictionary sets holds until the state before it comes back."""

    def make(k, _):
        gs = b"/ExtGState << /G << /LC 2 /ML %d /D [[2 1] 2] /FL 7 /RI /Perceptual /SMask << /S /Alpha >> >> >>" % (k + 2)
        line = b" 0 0 m 1 1 l S "
        return synth.one_page(b"1 J 1 j 5 M [3 %d] 0 d 4 i /Saturation ri%sq /G gs%sQ%s" % (k, line, line, line), gs).finish()

    d = _nations(spark, sf_dir, make).table("display_list", columns=("seq", "line_cap", "line_join", "miter", "dash", "dash_phase", "flatness", "intent", "smask"))
    return d.withColumn("dash", F.array_join(F.transform("dash", lambda x: x.cast("int").cast("string")), " "))


BLENDS = "Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split()


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, blend, round((i + 1) / 20.0, 6)::DOUBLE AS alpha FROM nation, {_values(list(enumerate(BLENDS)))} v(i, blend)")
def blend_modes(spark, sf_dir):
    def make(k, _):
        states = b" ".join(b"/G%d << /BM /%s /CA %s >>" % (i, b.encode(), num((i + 1) / 20)) for i, b in enumerate(BLENDS))
        return synth.one_page(b" ".join(b"q /G%d gs 0 0 m 1 1 l S Q" % i for i in range(len(BLENDS))), b"/ExtGState << %s >>" % states).finish()

    return _nations(spark, sf_dir, make).table("display_list", columns=("seq", "blend", "alpha")).withColumn("alpha", F.round("alpha", 6))


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 2 WHEN 0 THEN '1 0' END AS decode, p_partkey % 3 = 0 AS interpolate, ['AbsoluteColorimetric', 'RelativeColorimetric', 'Saturation', 'Perceptual'][p_partkey % 4 + 1] AS intent, p_partkey % 5 < 2 AS has_smask,
CASE p_partkey % 5 WHEN 0 THEN '0.5' END AS matte FROM part""")
def image_attributes(spark, sf_dir):
    def make(r):
        k = r["p_partkey"]
        intent = [b"AbsoluteColorimetric", b"RelativeColorimetric", b"Saturation", b"Perceptual"][k % 4]
        extra = (b"/Decode [1 0] " if k % 2 == 0 else b"") + (b"/Interpolate true " if k % 3 == 0 else b"") + b"/Intent /%s " % intent + (b"/SMask 7 0 R" if k % 5 < 2 else b"")
        own = b"/Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 "
        return synth.one_page(b"", IM, extra={6: synth.stream(b"\0", own + extra), 7: synth.stream(b"\0", own + (b"/Matte [0.5]" if k % 5 == 0 else b""))}).finish()

    i = Engine(write_pdfs(dealt(read(spark, sf_dir, "part")), "p_partkey", make)).table("images", columns=("num", "decode", "interpolate", "intent", "has_smask", "matte")).where("num = 6")
    return i.select("doc_id", F.array_join(F.transform("decode", lambda x: x.cast("int").cast("string")), " ").alias("decode"), "interpolate", "intent", "has_smask", F.array_join(F.transform("matte", lambda x: x.cast("string")), " ").alias("matte"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, verb, what FROM nation, (VALUES ('stencil', 'St'), ('image', 'Im')) v(verb, what)")
def stencils(spark, sf_dir):
    def make(k, _):
        return synth.one_page(b"/St Do /Im Do /No Do", b"/XObject << /Im 6 0 R /St 7 0 R >>", extra={**IMAGE, 7: synth.stream(b"\x80", b"/Subtype /Image /Width 1 /Height 1 /ImageMask true")}).finish()

    return _nations(spark, sf_dir, make).table("display_list", columns=("verb", "what"))


@query("""SELECT s_suppkey AS doc_id, CAST(x AS INTEGER) AS x, CAST(least(255, floor(255 * greatest(0, least(1, 0.5 + (v - 0.5) / (a / 255.0))) + 0.5)) AS INTEGER) AS red, CAST(a AS INTEGER) AS alpha
FROM (SELECT s_suppkey, x, (s_suppkey * 3 + 40 * x) % 256 / 255.0 AS v, CASE WHEN x < 2 THEN 51 + s_suppkey % 100 ELSE 255 END AS a FROM supplier, range(4) r(x))""")
def soft_masks(spark, sf_dir):
    """A soft mask of half the width, and colours that were blended with a matte of one half."""

    def make(k, _):
        rgb = b"".join(bytes([(k * 3 + 40 * x) % 256, 0, 0]) for x in range(4))
        own = b"/Subtype /Image /Height 1 /BitsPerComponent 8 "
        image = synth.stream(rgb, own + b"/Width 4 /ColorSpace /DeviceRGB /SMask 7 0 R")
        return synth.one_page(b"", IM, extra={6: image, 7: synth.stream(bytes([51 + k % 100, 255]), own + b"/Width 2 /ColorSpace /DeviceGray /Matte [0.5 0.5 0.5]")}).finish()

    rows = _suppliers(spark, sf_dir, make).table("image_rgba", columns=("num", "values")).where("num = 6")
    pixel = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x"), "values")
    return pixel.select("doc_id", "x", F.get("values", F.col("x") * 4).alias("red"), F.get("values", F.col("x") * 4 + 3).alias("alpha"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, num::BIGINT AS num, CAST(x AS INTEGER) AS x, CAST(CASE num WHEN 6 THEN CASE x % 2 WHEN 0 THEN 0 ELSE 255 END WHEN 7 THEN CASE x WHEN n_nationkey % 4 THEN 0 ELSE 255 END ELSE CASE WHEN x < 2 THEN 0 ELSE 255 END END AS INTEGER) AS alpha
FROM nation, (VALUES (6), (7), (8)) v(num), range(4) r(x)""")
def image_masks(spark, sf_dir):
    """A stencil, a colour that is masked out, and an explicit mask."""

    def make(k, _):
        own, gray = b"/Subtype /Image /Height 1 /Width 4 ", b"/ColorSpace /DeviceGray /BitsPerComponent 8 "
        images = {6: synth.stream(b"\xa0", own + b"/ImageMask true"), 7: synth.stream(bytes([10, 20, 30, 40]), own + gray + b"/Mask [%d %d]" % ((10 * (k % 4 + 1),) * 2))}
        images |= {8: synth.stream(bytes(4), own + gray + b"/Mask 9 0 R"), 9: synth.stream(b"\x80", b"/Subtype /Image /Height 1 /Width 2 /ImageMask true")}
        return synth.one_page(b"", IM, extra=images).finish()

    rows = _nations(spark, sf_dir, make).table("image_rgba", columns=("num", "values")).where("num < 9")
    pixel = rows.select("doc_id", "num", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x"), "values")
    return pixel.select("doc_id", "num", "x", F.get("values", F.col("x") * 4 + 3).alias("alpha"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'jbig2' AS encoding, n_name AS shared, 'page' AS data FROM nation")
def jbig2_streams(spark, sf_dir):
    """Bytes that pass through undecoded, with the segments that they share."""

    def make(k, name):
        image = synth.stream(b"page", b"/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /JBIG2Decode /DecodeParms << /JBIG2Globals 7 0 R >>")
        return synth.one_page(b"", IM, extra={6: image, 7: synth.stream(name.encode(), flate=True)}).finish()

    i = _nations(spark, sf_dir, make).table("images", columns=("encoding", "jbig2_globals", "data"))
    return i.select("doc_id", "encoding", F.decode("jbig2_globals", "UTF-8").alias("shared"), F.decode("data", "UTF-8").alias("data"))


BITS_SQL = "SELECT s_suppkey AS doc_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((s_suppkey + 3 * y + x * (y + 1)) % {} AS INTEGER) AS value FROM supplier, range(3) a(y), range(5) b(x)"


def _bits(spark, sf_dir, bits: int) -> DataFrame:
    def make(k, _):
        rows = b""
        for y in range(3):
            whole = 0
            for x in range(5):
                whole = whole << bits | (k + 3 * y + x * (y + 1)) % (1 << min(bits, 10))
            size = -(-5 * bits // 8)
            rows += (whole << (8 * size - 5 * bits)).to_bytes(size, "big")
        return synth.one_page(b"", IM, extra={6: synth.stream(rows, b"/Subtype /Image /Width 5 /Height 3 /ColorSpace /DeviceGray /BitsPerComponent %d" % bits)}).finish()

    return _suppliers(spark, sf_dir, make).table("image_pixels", columns=("y", "values")).select("doc_id", "y", F.posexplode("values").alias("x", "value"))


@query(BITS_SQL.format(2))
def pixels_1_bit(spark, sf_dir):
    return _bits(spark, sf_dir, 1)


@query(BITS_SQL.format(4))
def pixels_2_bits(spark, sf_dir):
    return _bits(spark, sf_dir, 2)


@query(BITS_SQL.format(16))
def pixels_4_bits(spark, sf_dir):
    return _bits(spark, sf_dir, 4)


@query(BITS_SQL.format(1024))
def pixels_16_bits(spark, sf_dir):
    return _bits(spark, sf_dir, 16)


@query("SELECT s_suppkey AS doc_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((s_suppkey * (y + 2) + 7 * x + 3 * x * y * (1 + x % 3)) % 256 AS INTEGER) AS value FROM supplier, range(10) a(y), range(18) b(x)")
def png_filters(spark, sf_dir):
    """Rows of six pixels of three bytes, each of the five filters in turn, from a writer of its own."""

    def make(k, _):
        rows = [bytes((k * (y + 2) + 7 * x + 3 * x * y * (1 + x % 3)) % 256 for x in range(18)) for y in range(10)]
        data = zlib.compress(synth.png_rows(rows, 3, [y % 5 for y in range(10)]))
        return synth.one_page(b"", IM, extra={6: synth.stream(data, b"/Subtype /Image /Width 6 /Height 10 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors 3 /Columns 6 >>")}).finish()

    return _suppliers(spark, sf_dir, make).table("image_pixels", columns=("y", "values")).select("doc_id", "y", F.posexplode("values").alias("x", "value"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, round(CASE i WHEN 0 THEN CASE n_nationkey % 2 WHEN 0 THEN 0.2 ELSE 0.6 END WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN 1 - t ELSE t END, 6)::DOUBLE AS red,
round(CASE i WHEN 0 THEN CASE n_nationkey % 2 WHEN 0 THEN 0.4 ELSE 0.8 END WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 1 ELSE t END, 6)::DOUBLE AS green FROM (SELECT *, n_nationkey / 25.0 AS t FROM nation), range(5) v(i)""")
def colour_families(spark, sf_dir):
    """Indexed, DeviceN through a calculator, and ICC profiles of three, four and one components."""

    def make(k, _):
        cs = b"/ColorSpace << /I [/Indexed /DeviceRGB 1 <336600 99CC00>] /N [/DeviceN [/A /B] /DeviceRGB 5 0 R] /P [/ICCBased 6 0 R] /Q [/ICCBased 7 0 R] /R [/ICCBased 8 0 R] >>"
        t, fill = num(k / 25), b"0 0 1 1 re f"
        body = b"/I cs %d sc %s /N cs %s 0.25 scn %s /P cs %s 0.5 0 scn %s /Q cs %s 0 0 0 scn %s /R cs %s sc %s" % (k % 2, fill, t, fill, t, fill, t, fill, t, fill)
        program = synth.stream(b"{ 0.75 }", b"/FunctionType 4 /Domain [0 1 0 1] /Range [0 1 0 1 0 1]")
        return synth.one_page(body, cs, extra={5: program, 6: synth.stream(b"", b"/N 3"), 7: synth.stream(b"", b"/N 4"), 8: synth.stream(b"", b"/N 1")}).finish()

    d = _nations(spark, sf_dir, make).table("display_list", columns=("seq", "rgb"))
    return d.select("doc_id", "seq", F.round(F.col("rgb")[0], 6).alias("red"), F.round(F.col("rgb")[1], 6).alias("green"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 2::BIGINT AS spaces, 4::BIGINT AS names FROM nation")
def equal_colour_spaces(spark, sf_dir):
    """Spaces are equal by what they are made of, not by their names or places."""

    def make(k, _):
        one = b"[/Indexed /DeviceRGB 1 <%06x000000>]" % k
        return synth.one_page(b"", b"/ColorSpace << /A %s /B 5 0 R /C [/ICCBased 6 0 R] /D [/ICCBased 7 0 R] >>" % one, extra={5: one, 6: synth.stream(b"", b"/N 3"), 7: synth.stream(b"x", b"/N 3")}).finish()

    s = _nations(spark, sf_dir, make).table("color_spaces", columns=("key", "structure"))
    return s.groupBy("doc_id").agg(F.count_distinct("structure").alias("spaces"), F.count("*").alias("names"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, (n_nationkey / 50.0)::DOUBLE AS red, 0.5::DOUBLE AS green, 0.125::DOUBLE AS blue FROM nation")
def shading_function_array(spark, sf_dir):
    def make(k, _):
        f = lambda top, n: b"<< /FunctionType 2 /Domain [0 1] /C0 [0] /C1 [%s] /N %d >>" % (top, n)
        sh = b"/Shading << /S << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 1] /Extend [true false] /Function [%s %s %s] >> >>" % (f(num(k / 25), 1), f(b"1", 1), f(b"1", 3))
        return synth.one_page(b"/S sh", sh).finish()

    middle = F.col("samples")[2]
    s = _nations(spark, sf_dir, make).table("shadings", columns=("samples",))
    return s.select("doc_id", *[F.round(middle[i], 6).alias(c) for i, c in enumerate(("red", "green", "blue"))])


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'fill' AS verb, 5.0::DOUBLE AS a, (n_nationkey + 10)::DOUBLE AS d, 20.0::DOUBLE AS tx, 30.0::DOUBLE AS ty FROM nation")
def annotation_appearances(spark, sf_dir):
    """The appearance's matrix, then the fit of its transformed box to the annotation's rectangle."""

    def make(k, _):
        look = synth.stream(b"0 0 1 1 re f", b"/Subtype /Form /BBox [0 0 2 2] /Matrix [1 0 0 1 0 0]")
        return synth.one_page(b"", page=b"/MediaBox [0 0 99 99] /Annots [<< /Subtype /Stamp /Rect [20 30 30 %d] /AP << /N 5 0 R >> >>]" % (50 + 2 * k), extra={5: look}).finish()

    return _nations(spark, sf_dir, make).table("display_list", columns=("verb", "ctm")).select("doc_id", "verb", *[F.round(f"ctm.{c}", 6).alias(c) for c in ("a", "d", "tx", "ty")])


# ---- objects, structure and encryption ------------------------------------------------------------------------------

KINDS = [(10, "null", "null"), (11, "boolean", "true"), (12, "integer", "7"), (13, "real", "7.5"), (14, "name", "/N"), (15, "string", "(s)"), (16, "array", "[1 2]"), (17, "dictionary", "<< /A 1 >>"), (18, "reference", "12 0 R")]


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, num::BIGINT AS num, kind FROM nation, {_values([x[:2] for x in [*KINDS, (19, 'stream', '')]])} v(num, kind)")
def object_types(spark, sf_dir):
    def make(k, _):
        w = synth.one_page(b"")
        for n, _, body in KINDS:
            w.add(body.encode(), n)
        w.add(synth.stream(b"endobj 1 0 obj (not an object) endobj"), 19)
        return w.finish()

    return _nations(spark, sf_dir, make).table("objects", columns=("num", "kind"), nums=tuple(range(10, 20)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, count(*)::BIGINT AS found, true AS recovered FROM nation, range(5) GROUP BY n_nationkey")
def scan_skips_streams(spark, sf_dir):
    """The scan for objects passes over what stands in streams, and a header in the middle of a word is none."""

    def make(k, _):
        w = synth.one_page(b"")
        w.add(synth.stream(b"99 0 obj << >> endobj trailer << /Root 99 0 R >>"), 5)
        return w.finish(xref=False) + b"%% 1\n"

    e = _nations(spark, sf_dir, make).bundle(objects={"columns": ("num",)}, headers={"columns": ("recovered",)})
    return e.select("doc_id", F.size("objects").cast("long").alias("found"), F.col("headers")[0]["recovered"].alias("recovered"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'objectNotFound' AS failure, 5::BIGINT AS num FROM nation")
def wrong_ids(spark, sf_dir):
    """An entry that leads to an object of another id is an error, not that object."""
    make = lambda k, _: synth.one_page(b"", extra={5: b"(x)"}).finish().replace(b"\n5 0 obj", b"\n6 0 obj")
    return _nations(spark, sf_dir, make).table("parse_errors", columns=("failure", "intent")).select("doc_id", "failure", "intent.num")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, category, key, num::BIGINT AS num, kind FROM nation, (VALUES ('Font', 'F1', 5, 'dictionary'), ('XObject', 'Im', 6, 'stream'), ('Properties', 'P', 0, 'dictionary')) v(category, key, num, kind)")
def page_resources(spark, sf_dir):
    make = lambda k, _: synth.one_page(b"", F1 + IM + b"/Properties << /P << /K 1 >> >>", extra={**FONT, **IMAGE}).finish()
    return _nations(spark, sf_dir, make).table("resources").select("doc_id", "category", "key", F.coalesce("ref.num", F.lit(0)).alias("num"), "kind")


@query("SELECT s_suppkey AS doc_id, s_name AS text FROM supplier")
def owner_password(spark, sf_dir):
    """The owner's password gives the user's, and that the file's key."""

    def make(k, name):
        w = synth.one_page(b"")
        trailer, key = synth.rc4_40(w, b"user", b"owner")
        w.objects[4] = synth.stream(synth.arcfour(synth.object_key(key, 4), b"BT /F1 12 Tf %s Tj ET" % synth.literal(name.encode())))
        return w.finish(trailer=trailer)

    return _suppliers(spark, sf_dir, make, password="owner").features(("text",)).select("doc_id", F.col("text.text").alias("text"))


@query("SELECT s_suppkey AS doc_id, s_name AS sealed, s_name AS plain FROM supplier")
def encrypted_strings(spark, sf_dir):
    """Strings of objects are decrypted; a stream whose filter is the identity is not encrypted."""

    def make(k, name):
        w = synth.one_page(b"")
        trailer, key = synth.rc4_40(w, b"", b"owner")
        w.add(b"<%s>" % synth.arcfour(synth.object_key(key, 5), name.encode()).hex().encode(), 5)
        w.add(synth.stream(name.encode(), b"/Filter /Crypt /DecodeParms << /Name /Identity >>"), 6)
        return w.finish(trailer=trailer)

    n = _suppliers(spark, sf_dir, make).table("object_nodes", columns=("num", "b"), nums=(5, 6), depth=0)
    of = lambda k: F.decode(F.max(F.when(F.col("num") == k, F.col("b"))), "UTF-8")
    return n.groupBy("doc_id").agg(of(5).alias("sealed"), of(6).alias("plain"))


@query("SELECT c_custkey AS doc_id, c_name AS text FROM customer")
def aes_256_text(spark, sf_dir):
    """Revision 6: the key of the file comes out of the password by the hardened hash."""
    key = bytes(range(32))
    trailer = synth.aes_256("pässword".encode(), key)
    sealed = F.aes_encrypt(F.concat(F.lit(b"BT /F1 12 Tf ("), F.encode(F.col("c_name"), "UTF-8"), F.lit(b") Tj ET")), F.lit(key), F.lit("CBC"), F.lit("PKCS"))

    def make(r):
        w = synth.one_page(b"")
        w.objects[4] = synth.stream(r["sealed"])
        return w.finish(trailer=trailer)

    docs = write_pdfs(dealt(read(spark, sf_dir, "customer").select("c_custkey", sealed.alias("sealed"))), "c_custkey", make)
    return Engine(docs, password="pässword").features(("text",)).select("doc_id", F.col("text.text").alias("text"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 1::BIGINT AS failures, CASE n_nationkey % 2 WHEN 0 THEN 'passwordRequired' ELSE 'unsupportedEncryption' END AS failure FROM nation")
def encryption_errors(spark, sf_dir):
    def make(k, _):
        w = synth.one_page(b"")
        trailer, _ = synth.rc4_40(w, b"user", b"owner")
        return w.finish(trailer=trailer if k % 2 == 0 else trailer.replace(b"/V 1", b"/V 9"))

    e = _nations(spark, sf_dir, make).table("parse_errors", columns=("failure",))
    return e.groupBy("doc_id").agg(F.count("*").alias("failures"), F.min("failure").alias("failure"))


# ---- calculator and geometry ----------------------------------------------------------------------------------------


def _calculate(spark, sf_dir, program: bytes, outputs: int) -> DataFrame:
    """The program on (p_size, p_partkey % 7 + 1), as a Column."""
    from vellum.functions.pdf_functions import compile_function

    f = _function(synth.stream(program, b"/FunctionType 4 /Domain [0 1000 0 1000] /Range [%s]" % b" ".join([b"-100000 100000"] * outputs)))
    outs = compile_function(f, [F.expr("double(p_size)"), F.expr("double(p_partkey % 7 + 1)")])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[F.round(c.cast("double"), 6).alias(f"v{i}") for i, c in enumerate(outs)])


PART = "(SELECT p_partkey AS k, p_size AS x, p_partkey % 7 + 1 AS y FROM part)"


@query(f"SELECT k, ceil(x / 3.0)::DOUBLE AS v0, floor(x / 3.0)::DOUBLE AS v1, trunc(x / 3.0)::DOUBLE AS v2, round(x / 3.0)::DOUBLE AS v3, x::DOUBLE AS v4, (x - y)::DOUBLE AS v5 FROM {PART}")
def calculator_rounding(spark, sf_dir):
    # x y: x - y goes below x; then four ways to round x / 3, and x as the absolute of its negative.
    return _calculate(spark, sf_dir, b"{ 1 index exch sub exch dup 3 div dup ceiling exch dup floor exch dup truncate exch round 5 -1 roll neg abs 6 -1 roll }", 6)


@query(f"SELECT k, round(ln(x), 6) AS v0, round(log10(x), 6) AS v1, round(sin(radians(10.0 * x)), 6) AS v2, round(cos(radians(10.0 * x)), 6) AS v3, round(degrees(atan2(x, y)), 6) AS v4, round(sqrt(x), 6) AS v5 FROM {PART}")
def calculator_reals(spark, sf_dir):
    return _calculate(spark, sf_dir, b"{ 1 index ln 2 index log 3 index 10 mul sin 4 index 10 mul cos 5 index 5 index atan 6 index 0.5 exp 8 -2 roll pop pop }", 6)


@query(f"SELECT k, (x & y)::DOUBLE AS v0, (x | y)::DOUBLE AS v1, xor(x, y)::DOUBLE AS v2, (-x - 1)::DOUBLE AS v3, (x // y)::DOUBLE AS v4, (x * 4)::DOUBLE AS v5, (x // 2)::DOUBLE AS v6 FROM {PART}")
def calculator_integers(spark, sf_dir):
    program = b"{ cvi exch cvi exch 1 index 1 index and 2 index 2 index or 3 index 3 index xor 4 index not 5 index 5 index idiv 6 index 2 bitshift 7 index -1 bitshift 9 -2 roll pop pop }"
    return _calculate(spark, sf_dir, program, 7)


@query(f"SELECT k, (x = y)::INT::DOUBLE AS v0, (x <> y)::INT::DOUBLE AS v1, (x >= y)::INT::DOUBLE AS v2, (x <= y)::INT::DOUBLE AS v3, (x < y)::INT::DOUBLE AS v4 FROM {PART}")
def calculator_comparisons(spark, sf_dir):
    told = b"{ 1 } { 0 } ifelse"
    return _calculate(spark, sf_dir, b"{ %s 2 copy lt %s 3 1 roll pop pop }" % (b" ".join(b"2 copy %s %s 3 1 roll" % (w, told) for w in (b"eq", b"ne", b"ge", b"le")), told), 5)


@query(f"SELECT k, (CASE WHEN x > y AND x < 20 THEN 2 ELSE 1 END)::DOUBLE AS v0, y::DOUBLE AS v1, x::DOUBLE AS v2, (x + 0.5)::DOUBLE AS v3 FROM {PART}")
def calculator_stack(spark, sf_dir):
    """Booleans, if, exch, dup, copy and roll."""
    return _calculate(spark, sf_dir, b"{ exch 2 copy lt 1 index 20 lt and true and false or { 2 } { 1 } ifelse 3 1 roll dup cvr 0.5 add dup 30000 gt { pop 0 } if }", 4)


@query("SELECT p_partkey AS k, (greatest(p_size + 4, 2 * p_size + 1) - least(p_size, 2 * p_size))::DOUBLE AS width, 9.0::DOUBLE AS height FROM part")
def rect_union(spark, sf_dir):
    both = G.union(G.rect(F.col("p_size"), F.lit(0), F.lit(4), F.lit(3)), G.rect(F.col("p_size") * 2, F.lit(5), F.lit(1), F.lit(4)))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), both["width"].alias("width"), both["height"].alias("height"))


@query(f"SELECT p_partkey AS k, encoding, CAST(code AS INTEGER) AS code, glyph FROM part JOIN {_values([(i, *g) for i, g in enumerate(GLYPHS)])} v(i, encoding, code, glyph) ON i = p_partkey % {len(GLYPHS)}")
def base_encoding_glyphs(spark, sf_dir):
    """Codes that the rows of a table choose, in the encoding that they choose."""
    from vellum.operators.text import base_encodings

    nth = (F.col("p_partkey") % len(GLYPHS)).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), nth)
    asked = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), pick([e for e, _, _ in GLYPHS]).alias("encoding"), pick([c for _, c, _ in GLYPHS]).alias("code"))
    return asked.join(F.broadcast(base_encodings(spark)), ["encoding", "code"]).select("k", "encoding", "code", "glyph")


@query("""SELECT c_custkey AS doc_id, kind, num::BIGINT AS num, (c_nationkey + 5)::DOUBLE AS width, space, isolated, round(back, 6)::DOUBLE AS back, transfer, round(middle, 6)::DOUBLE AS middle FROM customer, LATERAL (VALUES
('Luminosity', 5, 'DeviceRGB', true, c_nationkey / 25.0, 'function', 0.25 + c_nationkey / 100.0), ('Alpha', 6, NULL, false, NULL, 'Identity', NULL)) v(kind, num, space, isolated, back, transfer, middle)""")
def soft_mask_groups(spark, sf_dir):
    """The groups of soft masks with their colour space, what lies behind them, and the transfer of their values."""

    def make(r):
        k = r["c_nationkey"]
        group = synth.stream(b"0 0 1 1 re f", b"/Type /XObject /Subtype /Form /BBox [0 0 %d 7] /Group << /S /Transparency /CS /DeviceRGB /I true >>" % (k + 5))
        plain = synth.stream(b"", b"/Type /XObject /Subtype /Form /BBox [0 0 %d 7]" % (k + 5))
        one = b"/A << /SMask << /S /Luminosity /G 5 0 R /BC [%s 0 0] /TR << /FunctionType 2 /Domain [0 1] /C0 [%s] /C1 [%s] /N 2 >> >> >>" % (num(k / 25), num(k / 100), num(1 + k / 100))
        return synth.one_page(b"/A gs", b"/ExtGState << %s /B << /SMask << /S /Alpha /G 6 0 R /TR /Identity >> >> /C << /SMask /None >> >>" % one, extra={5: group, 6: plain}).finish()

    m = Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)).table("soft_masks")
    return m.select("doc_id", "kind", "ref.num", "bbox.width", "space", "isolated", F.round(F.col("backdrop")[0], 6).alias("back"), "transfer", F.round(F.col("samples")[2], 6).alias("middle"))


@query("SELECT c_custkey AS doc_id, 5::BIGINT AS num, c_custkey * 3 AS value FROM customer")
def hybrid_sections(spark, sf_dir):
    """An object that only the stream beside a classic table names."""
    from vellum.queries import _chains

    def make(r):
        w = synth.one_page(b"")
        places = {n: w._put(n, w.objects[n]) for n in sorted(w.objects)}
        hidden = w._put(5, b"%d" % (r["c_custkey"] * 3)).to_bytes(4, "big")
        at = w._put(6, synth.stream(b"\1" + hidden + b"\0\0", b"/Type /XRef /W [1 4 2] /Index [5 1] /Size 7 /Root 1 0 R"))
        return w._table(places, 1, b"/XRefStm %d" % at)

    layouts, at, _ = _chains(Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)))
    own = layouts.where("num = 5 and revision = 0").select("doc_id", F.col("storage.start").alias("start"))
    return own.join(at, ["doc_id", "start"]).select("doc_id", F.lit(5).cast("long").alias("num"), F.col("i").alias("value"))


@query("""SELECT o_custkey AS doc_id, CAST(nth AS INTEGER) AS nth, num::BIGINT AS num FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (4, 5)) v(nth, num)
UNION ALL SELECT o_custkey, CAST(3 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER), 5 FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1""")
def objects_by_range(spark, sf_dir):
    """Objects in the order of their bytes, whatever their numbers and revisions."""
    from pyspark.sql import Window

    from vellum.queries import _chains, _customers

    layouts, _, _ = _chains(_customers(spark, sf_dir), nums=())
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("storage.start")) - 1
    return layouts.select("doc_id", nth.alias("nth"), "num")
