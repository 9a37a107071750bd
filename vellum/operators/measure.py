"""Where glyphs stand, by windows: text state in force, lines, and running sums of advances with a TJ's displacements between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import concat, rect, transform
from vellum.operators.state import framed, identity, matrices, of_numbers
from vellum.plans.cut import cut
from vellum.plans.tables import Engine

KEY = ["doc_id", "page_index"]
SHOWS = ["Tj", "TJ", "'", '"']
#: Operators that begin a line; those that also say its matrix.
LINES, PLACES = ["BT", "Td", "TD", "T*", "Tm", "'", '"'], ["BT", "Tm"]
LEAST_SIZE = 1e-6
STATE = {"font": "string", "size": "double", "tc": "double", "tw": "double", "tz": "double", "rise": "double", "leading": "double"}
FIRST = {"size": 1.0, "tc": 0.0, "tw": 0.0, "tz": 100.0, "rise": 0.0, "leading": 0.0}


def _number(i: int) -> Column:
    return F.get(F.col("nums"), F.lit(i))


def _sets() -> dict[str, Column]:
    """What each operator sets, null where it sets nothing."""
    op = F.col("op")
    return {
        "font": F.when(op == "Tf", F.col("name")),
        "size": F.when(op == "Tf", _number(0)),
        "tc": F.when((op == "Tc") | (op == '"'), _number(0)),
        "tw": F.when(op == "Tw", _number(0)).when(op == '"', _number(1)),
        "tz": F.when(op == "Tz", _number(0)),
        "rise": F.when(op == "Ts", _number(0)),
        "leading": F.when(op == "TL", _number(0)).when(op == "TD", -_number(1)),
    }


def text_state(ops: DataFrame) -> DataFrame:
    """ops with the text state in force at each (its own settings included), q and Q heeded.

    Within a frame the last setting holds, by a window; a frame without one takes what held at the q that opened it, which
    is looked up by doubling over the frames.
    """
    rows = framed(ops, KEY)
    inside = Window.partitionBy(*KEY, "_frame").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for name, value in _sets().items():
        rows = rows.withColumn(name, F.last(value.cast(STATE[name]), ignorenulls=True).over(inside))
    rows = cut(rows, "text")
    held = rows.where("op = 'q'").select(*KEY, F.col("seq").alias("_frame"), *STATE, F.when(F.col("_frame") >= 0, F.col("_frame")).alias("_up"))
    held = cut(held, "frames")
    while not held.where("_up is not null").isEmpty():
        up = held.select(*KEY, F.col("_frame").alias("_up"), F.struct(*STATE, F.col("_up").alias("next")).alias("_o"))
        told = held.join(up, [*KEY, "_up"], "left")
        held = cut(told.select(*KEY, "_frame", *[F.coalesce(c, F.col(f"_o.{c}")).alias(c) for c in STATE], F.col("_o.next").alias("_up")), "frames")
    outer = held.select(*KEY, "_frame", F.struct(*STATE).alias("_o"))
    out = rows.join(outer, [*KEY, "_frame"], "left")
    first = {c: F.coalesce(c, F.col(f"_o.{c}"), F.lit(FIRST[c])) if c in FIRST else F.coalesce(c, F.col(f"_o.{c}")) for c in STATE}
    return out.withColumns(first).drop("_o", "_frame")


def glyphs(engine: Engine, missing: float = 0.0) -> DataFrame:
    """(doc_id, page_index, seq, part, pos, font_num, font_gen, code, byte, offset, size, width, advance, at, text, ctm) of pages.

    Fonts with codes of one byte. A row is a glyph, or a displacement of a TJ (code null). at: how far it stands from its
    line's start; text: the line's matrix with its shift; seq numbers the page's operators, part those of a TJ, pos the glyphs of an operator.
    """
    parsed = cut(engine.bundle(operators={"columns": ("page_index", "seq", "op", "nums", "name", "bytes", "tj"), "ops": ("q", "Q", "cm", "BT", "Td", "TD", "T*", "Tm", "Tf", "Tc", "Tw", "Tz", "Ts", "TL", *SHOWS)}, resources={}, font_widths={}, fonts={"columns": ("num", "gen", "subtype")}), "parsed")
    rows = lambda name: parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    ops = rows("operators")
    state = text_state(ops)
    by = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda words: F.sum(F.when(F.col("op").isin(*words), 1).otherwise(0)).over(by)
    state = state.withColumns({"_place": count(PLACES), "_line": count(LINES)})
    placed = Window.partitionBy(*KEY, "_place").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    down = F.when(F.col("op").isin("T*", "'", '"'), -F.col("leading"))
    shift = {"_tx": F.when(F.col("op").isin("Td", "TD"), _number(0)), "_ty": F.when(F.col("op").isin("Td", "TD"), _number(1)).otherwise(down)}
    state = state.withColumns({c: F.sum(F.coalesce(v, F.lit(0.0))).over(placed) for c, v in shift.items()})
    state = state.withColumn("_m", F.coalesce(F.last(F.when(F.col("op") == "Tm", of_numbers(F.col("nums"))), ignorenulls=True).over(placed), identity()))
    moved = concat(F.struct(*[v.alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("_tx"), F.col("_ty")), strict=True)]), F.col("_m"))
    shown = state.where(F.col("op").isin(*SHOWS)).withColumn("text", moved)
    own = F.array(F.struct(F.col("bytes").alias("text"), F.lit(None).cast("double").alias("offset")))
    shown = shown.select(*KEY, "seq", "_line", *STATE, "text", F.posexplode(F.when(F.col("op") == "TJ", F.col("tj")).otherwise(own)).alias("part", "x"))
    each = F.when(F.col("x.text").isNull(), F.array(F.lit(None).cast("binary"))).otherwise(F.transform(F.sequence(F.lit(1), F.octet_length("x.text")), lambda i: F.substring(F.col("x.text"), i, 1)))
    each = F.when(F.octet_length("x.text") == 0, F.array().cast("array<binary>")).otherwise(each)
    items = shown.select(*KEY, "seq", "_line", *STATE, "text", "part", F.col("x.offset").alias("offset"), F.posexplode(each).alias("_j", "byte"))
    items = items.withColumn("code", F.conv(F.hex("byte"), 16, 10).cast("int"))
    names = rows("resources").where("category = 'Font' and ref is not null").select(*KEY, F.col("key").alias("font"), F.col("ref.num").alias("font_num"), F.col("ref.gen").alias("font_gen"))
    simple = rows("fonts").where("subtype <> 'Type0'").select("doc_id", F.col("num").alias("font_num"), F.col("gen").alias("font_gen"))
    items = items.join(names, [*KEY, "font"]).join(simple, ["doc_id", "font_num", "font_gen"], "left_semi")
    widths = rows("font_widths").select("doc_id", F.col("num").alias("font_num"), F.col("gen").alias("font_gen"), "code", "width")
    items = items.join(widths, ["doc_id", "font_num", "font_gen", "code"], "left")
    size, h = F.greatest(F.col("size"), F.lit(LEAST_SIZE)), F.col("tz") / 100
    items = items.withColumn("width", F.when(F.col("code").isNotNull(), F.coalesce("width", F.lit(missing))))
    glyph = (F.col("width") / 1000 * size + F.col("tc") + F.when(F.col("code") == 32, F.col("tw")).otherwise(0.0)) * h
    items = items.withColumn("advance", F.when(F.col("code").isNull(), -F.coalesce("offset", F.lit(0.0)) / 1000 * F.col("size") * h).otherwise(glyph))
    along = Window.partitionBy(*KEY, "_line").orderBy("seq", "part", "_j").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("at", F.coalesce(F.sum("advance").over(along), F.lit(0.0)))
    pos = F.sum(F.when(F.col("code").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*KEY, "seq").orderBy("part", "_j")) - 1
    items = items.withColumn("pos", pos.cast("int"))
    ctm = matrices(ops.where(F.col("op").isin("q", "Q", "cm", *SHOWS)).select(*KEY, "seq", "op", "nums"), KEY).select(*KEY, "seq", F.col("m").alias("ctm"))
    out = items.join(ctm, [*KEY, "seq"])
    return out.select(*KEY, "seq", "part", "pos", "font_num", "font_gen", "code", "byte", "offset", "size", "rise", "width", "advance", "at", "text", "ctm")


def _shifted(x: Column, y: Column, m: Column) -> Column:
    return concat(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), x.alias("tx"), y.alias("ty")), m)


def origins(found: DataFrame) -> DataFrame:
    """Glyphs alone, with x and y of their origins on the page."""
    m = concat(_shifted(F.col("at"), F.col("rise"), F.col("text")), F.col("ctm"))
    return found.where("code is not null").withColumn("_o", m).withColumns({"x": F.col("_o.tx"), "y": F.col("_o.ty")}).drop("_o")


def runs(found: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, bytes, bounds): a text operator's bytes and the box around its parts; fonts (doc_id, num, gen, up, down)."""
    part = found.where("code is not null").groupBy(*KEY, "seq", "part", "font_num", "font_gen").agg(
        F.min("at").alias("_a"), F.sum("advance").alias("_w"), F.min_by("text", "pos").alias("text"), F.min_by("ctm", "pos").alias("ctm"), F.min_by("size", "pos").alias("size"), F.min_by("at", "pos").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "byte"))), lambda x: F.hex(x["byte"])), "").alias("_hex"),
    )
    part = part.join(fonts.select("doc_id", F.col("num").alias("font_num"), F.col("gen").alias("font_gen"), "up", "down"), ["doc_id", "font_num", "font_gen"])
    size = F.greatest(F.col("size"), F.lit(LEAST_SIZE))
    box = rect(F.lit(0.0), F.col("down") * size, F.greatest(F.col("_w"), F.lit(0.0)), F.greatest((F.col("up") - F.col("down")) * size, F.lit(0.0)))
    part = part.withColumn("b", transform(concat(_shifted(F.col("at"), F.lit(0.0), F.col("text")), F.col("ctm")), box))
    g = part.groupBy(*KEY, "seq").agg(
        F.min("b.x").alias("x"), F.min("b.y").alias("y"), F.max(F.col("b.x") + F.col("b.width")).alias("_r"), F.max(F.col("b.y") + F.col("b.height")).alias("_t"),
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "_hex"))), lambda x: x["_hex"]), "")).alias("bytes"),
    )
    return g.select(*KEY, "seq", "bytes", rect(F.col("x"), F.col("y"), F.col("_r") - F.col("x"), F.col("_t") - F.col("y")).alias("bounds"))
