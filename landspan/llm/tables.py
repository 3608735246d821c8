"""Reading the tables and keying their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch handed back by the Python stages; long texts make rows large.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a row even if its doc_id is null or repeated.

    Rows that agree in both are taken for copies of each other, for which every operator here
    has the same result. The tag has 64 bits: of four million texts under one id, two agree by
    chance with a probability below one in a million.
    """
    return [
        F.coalesce(F.col(doc_id), F.lit(0).cast("long")).alias("key_id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("key_tag"),
    ]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
