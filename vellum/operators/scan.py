"""Objects of broken files, found by a scan of byte chunks: a large file is many rows, and its markers are searched in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes beyond a chunk's end in which a marker that begins in the chunk may end; white space within a marker is shorter.
BEYOND = 256
_REGULAR = r"[^\x00\t\n\x0c\r %()\[\]{}/<>\\]"
_BLANK = r"[\x00\t\n\x0c\r ]+"
_OBJECT = rf"(\d+){_BLANK}(\d+){_BLANK}obj(?!{_REGULAR})"
_WORD = r"(trailer|stream)(?![A-Za-z0-9])"
#: Where a marker begins: a split there leaves pieces whose lengths say where they stand.
_BEGINS = rf"(?<![0-9])(?={_OBJECT})|(?<![A-Za-z0-9])(?={_WORD})|(?=endstream)"


def chunks(docs: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(doc_id, start, lead, data): docs (doc_id, content) in chunks of size bytes with what is before (a byte) and beyond."""
    n = F.octet_length("content")
    rows = docs.where(n > 0).select("doc_id", "content", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(size).cast("long"))).alias("start"))
    lead = F.least(F.col("start"), F.lit(1)).cast("int")
    data = F.substring(F.col("content"), (F.col("start") - lead + 1).cast("int"), F.lit(size + BEYOND) + lead)
    return rows.select("doc_id", "start", lead.alias("lead"), F.lit(size).alias("size"), data.alias("data"))


def markers(parts: DataFrame) -> DataFrame:
    """(doc_id, at, kind, num, gen) of the object headers, trailers, and stream words of chunks, each in the chunk that it begins in."""
    pieces = F.transform(F.split(F.decode("data", "ISO-8859-1"), _BEGINS), lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(BEYOND)).alias("p")))
    rows = parts.select("doc_id", "start", "lead", "size", F.posexplode(pieces).alias("k", "x")).select("doc_id", "start", "lead", "size", "k", "x.*")
    order = Window.partitionBy("doc_id", "start").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("lead")
    rows = rows.withColumn("_at", at).where((F.col("_at") >= 0) & (F.col("_at") < F.col("size"))).select("doc_id", (F.col("start") + F.col("_at")).alias("at"), "p")
    part = lambda k: F.regexp_extract("p", "^" + _OBJECT, k)
    kind = F.when(F.col("p").startswith("endstream"), "endstream").when(F.col("p").rlike("^" + _WORD), F.regexp_extract("p", "^" + _WORD, 1)).when(part(1) != "", "object")
    return rows.select("doc_id", "at", kind.alias("kind"), F.when(part(1) != "", part(1)).cast("long").alias("num"), F.when(part(2) != "", part(2)).cast("long").alias("gen")).where("kind is not null")


def recovered(found: DataFrame) -> DataFrame:
    """(doc_id, num, gen, offset): the last header of each object in a file, those within stream bodies passed over.

    A body begins at the word stream and ends at the next endstream; what nothing ends is no body. So a header lies in one if
    the last of both words before it is stream and an endstream comes later.
    """
    by = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind").isin("stream", "endstream"), F.col("kind")), ignorenulls=True).over(by)
    final = F.max(F.when(F.col("kind") == "endstream", F.col("at"))).over(Window.partitionBy("doc_id"))
    told = found.withColumn("_last", F.coalesce(last, F.lit("endstream"))).withColumn("_final", F.coalesce(final, F.lit(-1)))
    out = told.where("kind = 'object' and not (_last = 'stream' and _final > at)")
    return out.groupBy("doc_id", "num", "gen").agg(F.max("at").alias("offset"))
