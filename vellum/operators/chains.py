"""Chains of cross-reference sections as relations: their order by places or by doubling, then revisions and extents by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.layouts import object_layouts
from vellum.plans.cut import cut, joined_by_shuffle


def in_order(sections: DataFrame, headers: DataFrame) -> DataFrame:
    """sections (doc_id, at, prev, hybrid, ...) with section_ord, the order in which a reader comes to them, and nothing that it does not come to.

    Updates go to a file's end, so in most files each section leads to the next one before it in the file, and the order is
    that of the places: one window tells so of a document, and gives it. The documents of which that does not hold, or that
    have hybrids, are ordered by doubling.
    """
    cols = sections.columns
    down = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    found = sections.join(joined_by_shuffle(headers.select("doc_id", F.col("xref_start").alias("_start"))), "doc_id")
    found = found.withColumns({"_nth": (F.row_number().over(down) - 1).cast("long"), "_next": F.lead("at").over(down)})
    follows = F.col("hybrid").isNull() & F.col("prev").eqNullSafe(F.col("_next")) & (F.col("prev").isNull() | (F.col("prev") < F.col("at"))) & ((F.col("_nth") > 0) | (F.col("at") == F.col("_start")))
    found = cut(found.withColumn("_plain", F.min(F.coalesce(follows, F.lit(False))).over(Window.partitionBy("doc_id"))).select(*cols, F.col("_nth").alias("section_ord"), "_plain"), "sections")
    plain, others = found.where("_plain").select(*cols, "section_ord"), found.where("not _plain").select(*cols)
    if others.isEmpty():
        return plain
    order = _by_doubling(others.select("doc_id", "at", "prev", "hybrid"), headers)
    return plain.union(others.join(order, ["doc_id", "at"]).select(*cols, F.col("section_ord").cast("long").alias("section_ord")))


def section_order(sections: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, at, section_ord): sections (doc_id, at, prev, hybrid) in the order in which a reader comes to them."""
    return in_order(sections.select("doc_id", "at", "prev", "hybrid"), headers).select("doc_id", "at", "section_ord")


def _by_doubling(sections: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, at, section_ord) of whatever sections there are.

    From the section that the file's end names, each leads to the one before it (prev), and its hybrid comes right after
    it. Which sections 2^k steps lead to doubles in each round, so n revisions take log2(n) + 1 rounds; the least number of
    steps counts, which ends a circle; a section that came as a hybrid ends the chain that leads to it again.
    """
    jump = sections.where("prev is not null").select("doc_id", "at", F.col("prev").alias("to")).join(sections.select("doc_id", F.col("at").alias("to")), ["doc_id", "to"])
    jump = jump.select("doc_id", F.col("at").alias("src"), F.col("to").alias("at"), F.lit(None).cast("long").alias("steps"))
    reach = headers.select("doc_id", F.col("xref_start").alias("at")).join(sections.select("doc_id", "at"), ["doc_id", "at"])
    reach = reach.select("doc_id", F.lit(None).cast("long").alias("src"), "at", F.lit(0).cast("long").alias("steps"))
    # one table for both: those without src are reached from the file's end, the others lead from src to at
    state, size, width = cut(reach.union(jump), "chain"), -1, 1
    n = state.where("src is null").count()
    while n > size:
        size = n
        hop = state.where("src is not null").select("doc_id", F.col("src").alias("at"), F.col("at").alias("next"))
        moved = state.join(hop, ["doc_id", "at"]).select("doc_id", "src", F.col("next").alias("at"), (F.col("steps") + width).alias("steps"))
        state = cut(moved.union(state.where("src is null")).groupBy("doc_id", "src", "at").agg(F.min("steps").alias("steps")), "chain")
        n, width = state.where("src is null").count(), width * 2
    reach = state.where("src is null").select("doc_id", "at", "steps")
    end = headers.select("doc_id", F.col("xref_end").alias("_end"))
    both = sections.join(reach, ["doc_id", "at"]).join(end, "doc_id")
    hybrids = both.where("hybrid < _end").select("doc_id", F.col("hybrid").alias("at"), "steps", F.lit(1).alias("kind"))
    seen = both.select("doc_id", "at", "steps", F.lit(0).alias("kind")).union(hybrids)
    first = F.row_number().over(Window.partitionBy("doc_id", "at").orderBy("steps", "kind"))
    seen = seen.withColumn("_k", first)
    stop = F.min(F.when((F.col("kind") == 0) & (F.col("_k") > 1), F.col("steps"))).over(Window.partitionBy("doc_id"))
    seen = seen.withColumn("_stop", stop).where("_k = 1 and (_stop is null or steps < _stop)")
    return seen.select("doc_id", "at", (F.row_number().over(Window.partitionBy("doc_id").orderBy("steps", "kind")) - 1).alias("section_ord"))


def layouts_of_sections(sections: DataFrame, headers: DataFrame) -> DataFrame:
    """object_layouts from the rows of xref_sections, in whatever order those come."""
    ordered = in_order(sections.select("doc_id", "at", "prev", "hybrid", "entries"), headers)
    return object_layouts(ordered.select("doc_id", "section_ord", F.explode("entries").alias("x")).select("doc_id", "section_ord", "x.*"), headers)
