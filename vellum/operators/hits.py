"""Which features lie under which regions of their page: a rectangle join over grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.plans.cut import cut, joined_by_shuffle

KEY = ["doc_id", "page_index"]
GRID = [*KEY, "level", "cx", "cy"]


def _level(r: Column) -> Column:
    """The least power of two that is no smaller than either side."""
    return F.ceil(F.log2(F.greatest(r["width"], r["height"], F.lit(2.0**-10)))).cast("int")


def _in_cells(rows: DataFrame, rect: str, own: str, levels: Column) -> DataFrame:
    """rows once for each cell that they lie in, of each level from their own up: four of a level at most."""
    r = F.col(rect)
    rows = rows.withColumn(own, _level(r)).withColumn("level", F.explode(F.filter(levels, lambda x: x >= F.col(own))))
    size = F.pow(F.lit(2.0), F.col("level"))
    span = lambda at, wide: F.sequence(F.floor(at / size), F.floor((at + wide) / size))
    return rows.withColumn("cx", F.explode(span(r["x"], r["width"]))).withColumn("cy", F.explode(span(r["y"], r["height"])))


def hits(features: DataFrame, regions: DataFrame, most: int = 20_000) -> DataFrame:
    """features (doc_id, page_index, bounds, ...) with the regions (doc_id, page_index, region, rect) that they touch, once each.

    A rectangle lies in four cells at most of a grid no finer than itself. Two meet in the grid of the larger: each is filed
    in its own and in all coarser ones that occur, and a pair counts where one of both is at home. Of the cells in which they
    meet, the one with the lower left corner of what they share reports them. A cell with more than ``most`` features is
    split, and its regions go to all of its parts; so neither a crowded page nor a crowded cell is one task. Touching edges
    count; null rectangles touch nothing.
    """
    f = features.where("bounds is not null")
    r = regions.where("rect is not null and region is not null").select(*KEY, "region", "rect")
    found = f.select(_level(F.col("bounds")).alias("l")).union(r.select(_level(F.col("rect")).alias("l"))).distinct().collect()  # powers of two of page sizes
    levels = F.array(*[F.lit(x["l"]) for x in sorted(found)]).cast("array<int>")
    f, r = (joined_by_shuffle(_in_cells(*x, levels)) for x in ((f, "bounds", "_of"), (r, "rect", "_or")))
    full = cut(f.groupBy(*GRID).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")), "cells")
    f = f.join(full, GRID).withColumn("_part", F.pmod(F.xxhash64(*[c for c in features.columns]), F.col("_parts")).cast("int")).drop("_parts")
    r = r.join(full, GRID).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    both = joined_by_shuffle(f).join(r, [*GRID, "_part"]).where("_of = level or _or = level")
    a, b, size = F.col("bounds"), F.col("rect"), F.pow(F.lit(2.0), F.col("level"))
    touch = (a["x"] <= b["x"] + b["width"]) & (b["x"] <= a["x"] + a["width"]) & (a["y"] <= b["y"] + b["height"]) & (b["y"] <= a["y"] + a["height"])
    here = (F.floor(F.greatest(a["x"], b["x"]) / size) == F.col("cx")) & (F.floor(F.greatest(a["y"], b["y"]) / size) == F.col("cy"))
    return both.where(touch & here).drop("level", "cx", "cy", "_of", "_or", "_part")
