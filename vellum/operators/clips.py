"""What of a page's painted paths its clips leave: the page's own box first, then clips by q and Q, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.geometry import page_rect
from vellum.operators.paths import BEGINS, GOES_ON, KEY, PAINT, painted
from vellum.operators.state import inherited, matrices
from vellum.plans.cut import cut
from vellum.plans.tables import Engine

SIDES = ("left_", "bottom", "right_", "top")


def box(*sides: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(sides, SIDES, strict=True)])


def everything() -> Column:
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    return box(low, low, high, high)


def meet(p: Column, q: Column) -> Column:
    """What two boxes have in common; with a side beyond its opposite where that is nothing."""
    return box(F.greatest(p["left_"], q["left_"]), F.greatest(p["bottom"], q["bottom"]), F.least(p["right_"], q["right_"]), F.least(p["top"], q["top"]))


def around(segments: Column, m: Column) -> Column:
    """The box around all points of segments, control points included, where the matrix puts them."""
    flat = F.flatten(F.transform(segments, lambda s: s["at"]))
    xs, ys = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
    u = F.zip_with(xs, ys, lambda x, y: m["a"] * x + m["c"] * y + m["tx"])
    v = F.zip_with(xs, ys, lambda x, y: m["b"] * x + m["d"] * y + m["ty"])
    return box(F.array_min(u), F.array_min(v), F.array_max(u), F.array_max(v))


def visible(engine: Engine) -> DataFrame:
    """(doc_id, page_index, seq, part, verb, bounds, clip, visible) of what page contents fill and stroke, in page space.

    clip is the box around all clips in force at a painting operator: the page's box (crop within media), and the clips set
    before it that no Q has taken back. visible is null where bounds and clip have nothing in common, or the clip has no
    area; a line has none and is still seen. Boxes bound what is seen; for rectangles along the axes they are what is seen.
    A clip holds after the operator that paints its path, not for it. Line widths do not count.
    """
    wanted = ("q", "Q", "cm", *BEGINS, *GOES_ON, *PAINT, "W", "W*")
    parsed = cut(engine.bundle(operators={"columns": ("page_index", "seq", "op", "nums"), "ops": wanted}, pages={"columns": ("page_index", "crop", "media", "above")}), "parsed")
    rows = lambda name: parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    ops = rows("operators")
    at = matrices(ops.where(F.col("op").isin("q", "Q", "cm", *PAINT)), KEY).select(*KEY, "seq", "m")
    shapes = painted(ops).join(at, [*KEY, "seq"])
    shapes = cut(shapes.select(*KEY, "seq", "part", "verb", around(F.col("segments"), F.col("m")).alias("bounds")), "shapes")
    clips = shapes.where("verb in ('clip', 'eoclip')").select(*KEY, "seq", F.col("bounds").alias("own"))
    state = ops.where(F.col("op").isin("q", "Q", *PAINT)).select(*KEY, "seq", "op").join(clips, [*KEY, "seq"], "left")
    held = inherited(state, KEY, F.col("own").isNotNull(), F.col("own"), meet, everything(), "clip").where("op <> 'q'").select(*KEY, "seq", "clip")
    own = page_rect(F.col("crop"), F.col("media"), F.col("above"))
    pages = rows("pages").select(*KEY, box(own["x"], own["y"], own["x"] + own["width"], own["y"] + own["height"]).alias("page"))
    out = shapes.where("verb not in ('clip', 'eoclip')").join(held, [*KEY, "seq"]).join(pages, KEY)
    out = out.withColumn("clip", meet(F.col("clip"), F.col("page"))).withColumn("_v", meet(F.col("bounds"), F.col("clip")))
    seen = F.expr("clip.left_ < clip.right_ and clip.bottom < clip.top and _v.left_ <= _v.right_ and _v.bottom <= _v.top")
    return out.select(*KEY, "seq", "part", "verb", "bounds", "clip", F.when(seen, F.col("_v")).alias("visible"))
