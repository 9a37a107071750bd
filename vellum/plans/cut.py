"""Tables that cut lineage between the steps of iterative operators, and how tables of documents are joined."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def joined_by_shuffle(df: DataFrame) -> DataFrame:
    """df, whose joins are sort-merge joins unless the other side says broadcast.

    The rows that Python makes of a document, or that lie in compressed arrays, take many times the bytes that Spark expects
    of them: what it takes for a small side would be all documents in the driver and in every task.
    """
    return df.hint("merge")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once below spark.checkpoint.dir and read again, so that a lost executor costs one step at most.

    It is joined by shuffles. The folder is the one that driver and executors share; where it is unset, a local session takes a temporary one.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return joined_by_shuffle(spark.read.schema(df.schema).parquet(path))
