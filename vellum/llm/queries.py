"""The queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import default_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than cores is dealt out, larger ones are not shuffled."""
    df, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(Scratch(spark), _read(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    pages = _read(spark, sf_dir, "pages")
    return extract(Scratch(spark), pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(Scratch(spark), _read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "at_char")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(Scratch(spark), _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "p_quality", "kept")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import read_documents, write_token_files

    path = Scratch(spark).path("tokens")
    write_token_files(_read(spark, sf_dir, "documents"), path, "doc_id", "text", default_path(), end_id=2)
    return read_documents(spark, path)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(Scratch(spark), _read(spark, sf_dir, "documents"), similarity=(85, 100))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(Scratch(spark), _read(spark, sf_dir, "documents"), min_bytes=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    table = _read(spark, sf_dir, "embeddings")
    return nearest(Scratch(spark), table, table.where("vec_id % 100 = 0"), k=10)


URL_RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document that its path numbers; low quality or toxic is bad."""
    from .url_rules import judge, mine, path_of

    pages, labels = _read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "labels")
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:/|\.html)?$", 1)
    numbered = pages.withColumn("doc_id", F.when(number != "", number).cast("long"))
    labelled = numbered.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    scratch = Scratch(spark)
    return judge(scratch, pages, mine(scratch, labelled), URL_RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    pieces = token_pieces(_read(spark, sf_dir, "documents"), "doc_id", "text", default_path(), end_id=0, max_len=2048)
    return pack(Scratch(spark), pieces, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import variants

    return variants(Scratch(spark), _read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has its label moved on by one, so that some neighbours are of another label."""
    from .hard_negatives import hard_negatives

    table = _read(spark, sf_dir, "embeddings")
    table = table.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(Scratch(spark), table, table.where("vec_id % 100 = 0"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(Scratch(spark), _read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_embedding_dedup, op2_html_extraction, op3_mixing, op4_quality, op5_token_file, op6_minhash_dedup, op7_suffix_dedup, op8_nearest_neighbours, op9_url_filter, op10_packing, op11_spelling_variants, op12_hard_negatives, op13_language_id, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
