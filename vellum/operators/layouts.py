"""Cross-reference resolution as window functions over xref_entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.plans.cut import joined_by_shuffle


def object_layouts(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, num, gen, revision, storage): revision 0 is the newest; an object's extent ends where the next one begins.

    Windows are per document, so a task holds one document's entries, which one shuffle brings there.  Of a packed id only its newest sighting has a layout.
    """
    of_id = Window.partitionBy("doc_id", "num", "gen")
    entries = entries.join(joined_by_shuffle(headers.select("doc_id", F.col("xref_end").alias("_e"))), "doc_id", "left")
    ranked = entries.withColumn("revision", F.row_number().over(of_id.orderBy("section_ord", "kind")) - 1)
    first_packed = F.min(F.when(F.col("kind") == "packed", F.col("revision"))).over(of_id)
    ranked = ranked.withColumn("_p", first_packed).where((F.col("kind") == "offset") | (F.col("revision") == F.col("_p")))
    after = Window.partitionBy("doc_id").orderBy(F.desc("offset")).rangeBetween(Window.unboundedPreceding, -1)
    out = ranked.withColumn("end", F.when(F.col("kind") == "offset", F.coalesce(F.min("offset").over(after), "_e")))
    storage = F.struct("kind", F.col("offset").alias("start"), "end", "stm_num", "stm_index")
    return out.select("doc_id", "num", "gen", F.col("revision").cast("int").alias("revision"), storage.alias("storage"))


def resolve_latest(layouts: DataFrame) -> DataFrame:
    """What a look-up by id finds."""
    return layouts.where("revision = 0")


def navigate(layouts: DataFrame) -> DataFrame:
    """Where a viewer goes from a reference: the last layout of the id in sort order, which is the oldest."""
    return layouts.groupBy("doc_id", "num", "gen").agg(F.max_by("storage", "revision").alias("storage"), F.max("revision").alias("revision"))


def dereference(refs: DataFrame, objects: DataFrame, ref_col: str = "ref", hops: int = 4) -> DataFrame:
    """refs (doc_id, ref struct) with (kind, value, data) of what the reference leads to, through up to ``hops`` objects that are references themselves; NULL where it leads nowhere, kind reference where it goes on beyond the hops.

    Each hop is an equi-join on (doc_id, num, gen); the bound on hops ends what goes in circles.
    """
    newest = objects.where("revision = 0").select(F.col("doc_id").alias("_d"), F.col("num").alias("_n"), F.col("gen").alias("_g"), F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.col("data").alias("_data"), F.col("ref").alias("_ref"))
    cols = [c for c in refs.columns if c not in ("kind", "value", "data")]
    now = refs.select(*cols, F.col(f"{ref_col}.num").alias("_an"), F.col(f"{ref_col}.gen").alias("_ag"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("binary").alias("data"))
    for _ in range(hops):
        hit = now.join(newest, (F.col("doc_id") == F.col("_d")) & (F.col("_an") == F.col("_n")) & (F.col("_ag") == F.col("_g")), "left")
        final = F.col("_kind").isNotNull() & (F.col("_kind") != "reference")
        now = hit.select(*cols, F.when(~final, F.col("_ref.num")).alias("_an"), F.when(~final, F.col("_ref.gen")).alias("_ag"), *[F.coalesce(c, F.when(final, F.col(f"_{c}"))).alias(c) for c in ("kind", "value", "data")])
    return now.withColumn("kind", F.coalesce("kind", F.when(F.col("_an").isNotNull(), "reference"))).drop("_an", "_ag")
