"""From raw documents to packed training sequences: quality, near copies, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch
from vellum.llm.minhash import near_duplicates
from vellum.llm.mixing import mix
from vellum.llm.packing import pack_in_order, token_pieces, with_places
from vellum.llm.quality import classify
from vellum.llm.suffix import remove_repeats
from vellum.llm.tokens import default_path

ORACLE_SQL = None  # tokenizing and the fitted classifier are beyond SQL; tests hold the stages against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.

    Null and empty texts, and nulls in other columns, are judged like any value; rows that repeat are judged each and alike;
    a probability of exactly one half is kept; an empty table, or one without labels, comes back whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(Scratch(spark), docs, labels).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Of rows that repeat an id one stays, chosen by a hash of the row. A document without words is in no group, and stays; so
    does each row without an id. An empty table gives none.
    """
    scratch = Scratch(spark)
    found = near_duplicates(scratch, docs, similarity=(80, 100)).where("kept")
    kept = scratch.write(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "kept")

    def rows(ids: DataFrame) -> DataFrame:
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"])).select(*[docs[c] for c in docs.columns])

    several = kept.where("_id is not null and _n > 1")
    once = rows(kept.where("_id is null or _n = 1"))
    if several.isEmpty():
        return once
    first = rows(several).groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return once.unionByName(first.select("_row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that one with a smaller id has. A character cut in part goes as a whole.

    Null texts come back empty; rows that repeat an id do not match each other, and a null id matches nothing; every row
    comes back, if with an empty text; an empty table gives none.
    """
    cut = remove_repeats(Scratch(spark), docs, min_bytes=50, keep=docs.columns)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return cut.withColumns(new).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The documents in the order of the mixture, which packing keeps.

    Null sources are a source; null texts have no characters; rows that repeat share a place and stay; ties do not occur, as
    places are ordered by slot, place in the source and id; an empty table gives none.
    """
    mixed = mix(Scratch(spark), docs, weights=weights)
    order = ["slot", "at_char", "doc_id"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, window_tokens: int = 1 << 18) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences, which are numbered in the order of the documents' rows.

    Null and empty texts are the end id alone; rows that repeat are packed each; an empty table gives none.
    """
    pieces = token_pieces(with_places(docs), "doc_id", "text", default_path(), end_id=0, max_len=2048, keep=("_file", "_row"))
    return pack_in_order(Scratch(spark), pieces, 2048, window_tokens).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
