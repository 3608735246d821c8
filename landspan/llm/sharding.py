"""Shards by weighted rendezvous hashing (operator 6), DataFrame functions only.

Every shard j bids ``-weight / ln(u)`` for a row, u a hash of the row's key and j, and the
highest bid takes it. One more shard adds one more bid, so a row either stays or goes to the
new shard, and in expectation only the new shard's share moves.

Null keys are one key. Rows with equal keys share a shard. A null text has no bytes; empty
texts have size 1. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
# Parts of a shard that are numbered on their own; their sizes are a table of at most
# shards x PARTS rows.
PARTS = 1024


def _bid(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(-float(weight)) / F.ln((bits + F.lit(0.5)) / F.lit(float(2**53)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose bid is highest; of equal bids the first."""
    bids = F.array(*[_bid(key, j, w) for j, w in enumerate(weights)])
    return (F.array_position(bids, F.array_max(bids)) - 1).cast("int")


def with_slots(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    A shard is numbered in parts: rows within a part by a window, parts by running sums of
    their counts, so no task sees a whole shard.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(-1)), parts))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return rows.withColumn("place", F.row_number().over(within) - 1).join(
        offsets, ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("place")).cast("long"))


def assign_shards(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mean = sum(weights) / len(weights)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    now, grown = shard_of(F.col("doc_id"), weights), _bid(F.col("doc_id"), len(weights), mean)
    top = F.array_max(F.array(*[_bid(F.col("doc_id"), j, w) for j, w in enumerate(weights)]))
    rows = rows.withColumn("shard", now).withColumn(
        "grown_shard", F.when(grown > top, F.lit(len(weights))).otherwise(F.col("shard")))
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_rendezvous_shards(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards, keyed by doc_id."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)
