"""Images that pages draw, directly and through forms, as a recursive query over invocations.

A form is parsed once and its matrices are chained once, however many pages and forms draw it. An invocation carries the
matrix that it is drawn with, the stream whose resources hold, and the forms that it lies in; a form that lies in itself is
not drawn again. Each level is a join of the invocations with what their streams draw, written before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import concat, orientation, rect, transform
from vellum.operators.state import identity, matrices
from vellum.plans.cut import cut
from vellum.plans.tables import Engine


def images(engine: Engine) -> DataFrame:
    """(doc_id, page_index, seq, num, gen, bounds, matrix) of the images of pages in drawing order: the features of kind image.

    Operators leave Python as rows; what holds at each, what names mean, and the forms within forms are relations.
    """
    parsed = cut(engine.bundle(stream_operators={"ops": ("q", "Q", "cm", "Do")}, xobjects={}, forms={}), "parsed")
    rows = lambda name: parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    owner = F.coalesce(F.concat(F.lit("p"), F.col("page_index").cast("string")), F.concat_ws(".", F.lit("f"), "num", "gen"))
    ops = rows("stream_operators").withColumn("owner", owner)
    draws = matrices(ops.select("doc_id", "owner", "seq", "op", "nums", "name"), ["doc_id", "owner"])
    draws = cut(draws.select("doc_id", "owner", "seq", "name", "m"), "draws")
    names = rows("xobjects").select("doc_id", owner.alias("res"), F.col("key").alias("name"), "kind", "ref", F.concat_ws(".", F.lit("f"), "target.num", "target.gen").alias("target"))
    forms = rows("forms").select("doc_id", F.concat_ws(".", F.lit("f"), "num", "gen").alias("target"), F.coalesce("matrix", identity()).alias("own_m"), "own")
    none = F.array().cast("array<string>")
    now = ops.where("page_index is not null").select("doc_id", "page_index", "owner").distinct()
    now = now.select("doc_id", "page_index", "owner", F.col("owner").alias("res"), none.alias("path"), F.array().cast("array<int>").alias("order"), identity().alias("outer"))
    found = None
    while True:
        hit = now.join(draws, ["doc_id", "owner"]).join(names, ["doc_id", "res", "name"])
        hit = hit.withColumn("order", F.array_append("order", F.col("seq"))).withColumn("outer", concat(F.col("m"), F.col("outer")))
        hit = cut(hit.where("kind = 'Image' or not array_contains(path, target)").drop("m", "seq", "name", "owner"), "drawn")
        own = hit.where("kind = 'Image'").select("doc_id", "page_index", "order", "ref", "outer")
        found = own if found is None else found.unionByName(own)
        inner = hit.where("kind = 'Form'").join(forms, ["doc_id", "target"])
        if inner.isEmpty():
            break
        res = F.when(F.col("own"), F.col("target")).otherwise(F.col("res"))
        now = inner.select("doc_id", "page_index", F.col("target").alias("owner"), res.alias("res"), F.array_append("path", F.col("target")).alias("path"), "order", concat(F.col("own_m"), F.col("outer")).alias("outer"))
    unit = rect(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    seq = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("order")) - 1
    return found.select("doc_id", "page_index", seq.alias("seq"), "ref.num", "ref.gen", transform(F.col("outer"), unit).alias("bounds"), orientation(F.col("outer")).alias("matrix"))
