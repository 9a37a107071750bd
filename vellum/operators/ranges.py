"""Range joins in which the first range that holds a value counts.

Ranges are first cut into disjoint segments, each with the first range over it; a value then has one segment at most, found
by an as-of join: values and segment starts in one order, the last start carried along by a window.

Ranges that overlap none, the usual case, are segments as they are. Where ranges overlap, the points at which one begins or
ends number the pieces between them; a range covers a run of pieces, that is at most two blocks of each power of two; the
first range of each block is kept; and a piece takes the first of the blocks that hold it, one of each size. So n ranges that
overlap make 2 n log(n) rows, however deep they lie in each other, and no row count depends on values times ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def disjoint(ranges: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, lo, hi, columns) of segments that do not overlap, from ranges (key, pos, lo, hi, columns): least pos first.

    Ranges whose hi lies below lo hold nothing.
    """
    order = Window.partitionBy(*key).orderBy("lo", "hi", "pos")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.where("lo <= hi").select(*key, "pos", "lo", "hi", F.struct(*columns).alias("_v"))
    r = r.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)).withColumn("_isle", F.sum("_new").over(order))
    isle = [*key, "_isle"]
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*isle)))
    alone, mixed = r.where("_n = 1").select(*key, "lo", "hi", "_v"), r.where("_n > 1")
    points = mixed.select(*isle, F.explode(F.array("lo", F.col("hi") + 1)).alias("at")).distinct()
    by_point = Window.partitionBy(*isle).orderBy("at")
    points = points.withColumn("_i", F.row_number().over(by_point) - 1).withColumn("_end", F.lead("at").over(by_point) - 1)
    start, stop = (points.select(*isle, F.col("at").alias(f"_{c}"), F.col("_i").alias(c)) for c in ("first", "last"))
    runs = mixed.withColumns({"_first": F.col("lo"), "_last": F.col("hi") + 1}).join(start, [*isle, "_first"]).join(stop, [*isle, "_last"])

    def blocks(level):
        size = _power(level)
        a, b = F.floor((F.col("first") + size - 1) / size).cast("long"), F.floor(F.col("last") / size).cast("long")
        own = F.array(F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1))
        return F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: F.struct(level.alias("level"), x.alias("block")))

    covered = runs.select(*isle, "pos", "_v", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), blocks))).alias("_b"))
    first = covered.groupBy(*isle, "_b.level", "_b.block").agg(F.min(F.struct("pos", "_v")).alias("_w"))
    pieces = points.where("_end is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(31))))
    pieces = pieces.join(first.groupBy(*isle, "level").agg(F.lit(1).alias("_one")), [*isle, "level"], "left_semi")
    pieces = pieces.withColumn("block", F.floor(F.col("_i") / _power(F.col("level"))).cast("long"))
    found = pieces.join(first, [*isle, "level", "block"]).groupBy(*isle, "at", "_end").agg(F.min("_w")["_v"].alias("_v"))
    return alone.union(found.select(*key, F.col("at").alias("lo"), F.col("_end").alias("hi"), "_v")).select(*key, "lo", "hi", "_v.*")


def first_match(values: DataFrame, ranges: DataFrame, key: list[str], value: str, columns: list[str]) -> DataFrame:
    """values (key, value, ...) with the columns of the first of their key's ranges that holds the value, else nulls.

    The window holds the distinct values and the ranges of one key.
    """
    own = [f"_{c}" if c in ("lo", "hi") else c for c in columns]  # a range's own ends, beside those of its segments
    segments = disjoint(ranges.withColumns({"_lo": F.col("lo"), "_hi": F.col("hi")}), key, own)
    starts = segments.select(*key, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("hi").alias("_to"), *own).alias("_s"))
    asked = values.select(*key, F.col(value).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_s"].dataType).alias("_s")).distinct()
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_at", "_kind"))
    hits = starts.union(asked).withColumn("_s", last).where((F.col("_kind") == 1) & (F.col("_s._to") >= F.col("_at")))
    hits = hits.select(*key, F.col("_at").alias(value), *[F.col(f"_s.{o}").alias(c) for o, c in zip(own, columns, strict=True)])
    return values.drop(*columns).join(hits, [*key, value], "left")
