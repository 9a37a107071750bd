"""Paths of content streams as relations: which segments are legal, what is painted, and what clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "page_index"]
# Fixed values of the format: what each painting operator does, in this order.
PAINT = {
    "S": ["stroke"], "s": ["stroke"], "f": ["fill"], "F": ["fill"], "f*": ["eofill"], "B": ["fill", "stroke"], "B*": ["eofill", "stroke"],
    "b": ["fill", "stroke"], "b*": ["eofill", "stroke"], "n": [],
}
#: Painting operators that close the last subpath first.
CLOSING = ["s", "b", "b*"]
BEGINS, GOES_ON = ["m", "re"], ["l", "c", "v", "y", "h"]
SEGMENT = "array<struct<verb:string,at:array<double>>>"


def painted(ops: DataFrame) -> DataFrame:
    """ops (doc_id, page_index, seq, op, nums) to (doc_id, page_index, seq, part, verb, segments): fills, strokes and clips.

    A painting operator ends a path, so the number of those before an operator says which path it belongs to. A line, a curve
    or a close counts only after a move or a rectangle of the same path, where there is a current point; a path without
    any of them, or of moves alone, paints nothing and clips nothing. A clip waits for the path's painting operator, unless a
    Q comes between. Current points are carried along by windows; a path meets in one row when it is painted.
    """
    by = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("op").isin(*PAINT)
    rows = ops.where(F.col("op").isin(*BEGINS, *GOES_ON, *PAINT, "W", "W*", "Q"))
    rows = rows.withColumn("_path", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(by), F.lit(0)))
    inside = Window.partitionBy(*KEY, "_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    number = lambda i: F.element_at("nums", i)
    begun = F.max(F.when(F.col("op").isin(*BEGINS), F.array(number(1), number(2)))).over(inside).isNotNull()
    rows = rows.withColumn("_legal", F.col("op").isin(*BEGINS) | ((F.col("op").isin(*GOES_ON) | F.col("op").isin(*CLOSING)) & begun))
    start = F.last(F.when(F.col("op").isin(*BEGINS), F.array(number(1), number(2))), ignorenulls=True).over(inside)
    rows = rows.withColumn("_start", start)
    point = F.when(F.col("op").isin(*BEGINS), F.array(number(1), number(2))).when(F.col("op") == "h", F.col("_start")).when(F.col("op").isin("l", "c", "v", "y"), F.array(number(-2), number(-1)))
    rows = rows.withColumn("_at", F.last(F.when(F.col("_legal"), point), ignorenulls=True).over(inside))

    def segment(verb: str, at: Column) -> Column:
        return F.struct(F.lit(verb).alias("verb"), at.cast("array<double>").alias("at"))

    x, y, w, h, none = number(1), number(2), number(3), number(4), F.array()
    box = F.array(segment("m", F.array(x, y)), segment("l", F.array(x + w, y)), segment("l", F.array(x + w, y + h)), segment("l", F.array(x, y + h)), segment("h", none))
    made = (
        F.when(F.col("op").isin("m"), F.array(segment("m", F.col("nums"))))
        .when(F.col("op") == "re", box)
        .when(F.col("op") == "l", F.array(segment("l", F.col("nums"))))
        .when(F.col("op") == "c", F.array(segment("c", F.col("nums"))))
        .when(F.col("op") == "v", F.array(segment("c", F.concat("_at", "nums"))))
        .when(F.col("op") == "y", F.array(segment("c", F.concat("nums", F.slice("nums", -2, 2)))))
        .when(F.col("op").isin("h", *CLOSING), F.array(segment("h", none)))
    )
    rows = rows.withColumn("_made", F.when(F.col("_legal"), made))
    drawn = F.max(F.when(F.col("_legal") & (F.col("op") != "m"), 1).otherwise(0))
    waits = F.max_by(F.col("op"), F.when(F.col("op").isin("W", "W*", "Q"), F.col("seq")))
    paths = rows.groupBy(*KEY, "_path").agg(
        drawn.alias("_drawn"),
        F.when(waits == "W", "clip").when(waits == "W*", "eoclip").alias("_clip"),
        F.max(F.when(ends, F.struct("seq", "op"))).alias("_end"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("_made").isNotNull(), F.struct("seq", "_made")))), lambda s: s["_made"])).alias("segments"),
    )
    paints = F.create_map(*[x for op, verbs in PAINT.items() for x in (F.lit(op), F.array(*map(F.lit, verbs)).cast("array<string>"))])
    verbs = F.filter(F.concat(F.element_at(paints, F.col("_end.op")), F.array("_clip")), lambda v: v.isNotNull())
    out = paths.where("_end is not null and _drawn = 1").select(*KEY, F.col("_end.seq").alias("seq"), F.posexplode(verbs).alias("part", "verb"), F.col("segments").cast(SEGMENT).alias("segments"))
    return out
