"""Rectangles and matrices as Columns: structs of doubles, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x:double,y:double,width:double,height:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,tx:double,ty:double>"


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("width"), h.cast("double").alias("height"))


def rect_from_corners(a: Column, b: Column, c: Column, d: Column) -> Column:
    return rect(F.least(a, c), F.least(b, d), F.abs(c - a), F.abs(d - b))


def intersection(p: Column, q: Column) -> Column:
    """NULL where the rectangles have no area in common."""
    x, y = F.greatest(p["x"], q["x"]), F.greatest(p["y"], q["y"])
    w = F.least(p["x"] + p["width"], q["x"] + q["width"]) - x
    h = F.least(p["y"] + p["height"], q["y"] + q["height"]) - y
    return F.when((w > 0) & (h > 0), rect(x, y, w, h))


def union(p: Column, q: Column) -> Column:
    """The smallest rectangle that holds both."""
    x, y = F.least(p["x"], q["x"]), F.least(p["y"], q["y"])
    return rect(x, y, F.greatest(p["x"] + p["width"], q["x"] + q["width"]) - x, F.greatest(p["y"] + p["height"], q["y"] + q["height"]) - y)


def page_rect(crop: Column, media: Column, above: Column) -> Column:
    """Crop within media, else media; else crop; else media; else the size from above."""
    return F.when(crop.isNotNull() & media.isNotNull(), F.coalesce(intersection(crop, media), media)).otherwise(F.coalesce(crop, media, above))


def concat(m: Column, n: Column) -> Column:
    """m first, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"),
        (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["tx"] * n["a"] + m["ty"] * n["c"] + n["tx"]).alias("tx"),
        (m["tx"] * n["b"] + m["ty"] * n["d"] + n["ty"]).alias("ty"),
    )


def transform(m: Column, r: Column) -> Column:
    """The box around a transformed rectangle."""
    xs = [m["a"] * x + m["c"] * y + m["tx"] for x in (r["x"], r["x"] + r["width"]) for y in (r["y"], r["y"] + r["height"])]
    ys = [m["b"] * x + m["d"] * y + m["ty"] for x in (r["x"], r["x"] + r["width"]) for y in (r["y"], r["y"] + r["height"])]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def orientation(m: Column) -> Column:
    u, v = F.hypot(m["a"], m["b"]), F.hypot(m["c"], m["d"])
    one = [F.lit(x) for x in (1.0, 0.0, 0.0, 1.0)]
    unit = [m["a"] / u, m["b"] / u, m["c"] / v, m["d"] / v]
    near = F.lit(True)
    for p, q in zip(unit, one, strict=True):
        near = near & (F.abs(p - q) < 1e-6)
    zero = [F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty")]
    build = lambda cols: F.struct(*[c.alias(n) for c, n in zip(cols, "abcd", strict=True)], *zero)
    return F.when((u > 0) & (v > 0) & ~near, build(unit)).otherwise(build(one))


def contains(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x <= r["x"] + r["width"]) & (y >= r["y"]) & (y <= r["y"] + r["height"])
