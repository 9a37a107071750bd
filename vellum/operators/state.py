"""The graphics state's matrix as relations: q and Q matched by depth, what they save chained by doubling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import MATRIX, concat
from vellum.plans.cut import cut


def identity() -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True)]).cast(MATRIX)


def of_numbers(nums: Column) -> Column:
    return F.struct(*[F.get(nums, F.lit(i)).alias(n) for i, n in enumerate(("a", "b", "c", "d", "tx", "ty"))]).cast(MATRIX)


def framed(ops: DataFrame, key: list[str]) -> DataFrame:
    """ops (key, seq, op, ...) without Q, with _frame: the q (its seq) that each lies in, or a number below zero.

    The depth after each operator is a running sum of q less Q, lifted where a Q has nothing to close: such a Q goes back to
    the start, so frames without a q are told apart by the number of those. The frame of an operator at depth k is the last
    q that led to depth k, found by a window for each depth; a q itself lies in the frame around it.
    """
    by = Window.partitionBy(*key).orderBy("seq")
    run = F.sum(F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)).over(by)
    rows = ops.withColumn("_s", run)
    rows = rows.withColumn("_stray", -F.least(F.min("_s").over(by), F.lit(0)))
    rows = rows.withColumn("_after", F.col("_s") + F.col("_stray"))
    rows = rows.withColumn("_depth", F.col("_after") - F.when(F.col("op") == "q", 1).otherwise(0))
    # A q is a row of the depth that it lies in and opens a frame of the next.
    lies = rows.where("op <> 'Q'").withColumn("_opens", F.lit(None).cast("int"))
    opens = rows.where("op = 'q'").withColumn("_depth", F.col("_after")).withColumn("_opens", F.col("seq"))
    in_depth = Window.partitionBy(*key, "_depth").orderBy("seq")
    frame = F.when(F.col("_depth") == 0, -1 - F.col("_stray")).otherwise(F.last("_opens", ignorenulls=True).over(in_depth))
    return lies.unionByName(opens).withColumn("_frame", frame).where("_opens is null").drop("_s", "_stray", "_after", "_depth", "_opens")


def inherited(ops: DataFrame, key: list[str], sets: Column, own: Column, combine: Callable[[Column, Column], Column], empty: Column, name: str) -> DataFrame:
    """ops (key, seq, op, ...) other than Q, with a column of that name: what all operators that set something say together.

    What holds at an operator is the last that sets something before it in its frame, else the q that opened the frame; so
    each of those and every q has one that it goes on from, and what they add up to along those chains (by combine, which
    has to be associative, from empty) takes as many rounds as the longest has binary digits.
    """
    before = Window.partitionBy(*key, "_frame").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.last(F.when(sets, F.col("seq")), ignorenulls=True).over(before), F.when(F.col("_frame") >= 0, F.col("_frame")))
    placed = cut(framed(ops, key).withColumn("_up", base).drop("_frame"), "state")
    nodes = placed.where(sets | (F.col("op") == "q")).select(*key, F.col("seq").alias("_at"), F.when(sets, own).otherwise(empty).alias("_m"), "_up")
    nodes = cut(nodes, "state")
    while not nodes.where("_up is not null").isEmpty():
        up = nodes.select(*key, F.col("_at").alias("_up"), F.col("_m").alias("_n"), F.col("_up").alias("_next"))
        told = nodes.join(up, [*key, "_up"], "left")
        nodes = cut(told.select(*key, "_at", F.when(F.col("_n").isNull(), F.col("_m")).otherwise(combine(F.col("_m"), F.col("_n"))).alias("_m"), F.col("_next").alias("_up")), "state")
    all_ = placed.join(nodes.select(*key, F.col("_at").alias("_up"), "_m"), [*key, "_up"], "left")
    return all_.withColumn(name, F.coalesce("_m", empty)).drop("_m", "_up")


def matrices(ops: DataFrame, key: list[str]) -> DataFrame:
    """ops (key, seq, op, nums, ...) other than q, Q and cm, with m: the matrix in force at each, from that of the stream's start."""
    return inherited(ops, key, F.col("op") == "cm", of_numbers(F.col("nums")), concat, identity(), "m").where("op not in ('cm', 'q')")
