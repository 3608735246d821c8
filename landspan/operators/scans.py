"""Ordered scans that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Positions per bucket: the most rows one window task sorts for one key.
BUCKET_WIDTH = 1 << 20


def nearest(
    df: DataFrame, key: str, position: str, value: str, out: str,
    ahead: bool = False, width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add ``out``: the closest non-null ``value`` before each row of its key (after: ``ahead``).

    Two levels: a window within (key, position bucket), then one summary row per bucket
    carries the last value of the buckets before it.  A key that holds a third of all
    rows is sorted in many tasks, and only its bucket summaries meet in one.
    """
    buckets = df.withColumn("__bucket", F.floor(F.col(position) / width))

    def ordered(column: str):
        return F.col(column).desc() if ahead else F.col(column).asc()

    within = (
        Window.partitionBy(key, "__bucket").orderBy(ordered(position))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy("__key").orderBy(ordered("__at"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    held = F.when(F.col(value).isNotNull(), F.col(position))
    edge = F.min_by(value, held) if ahead else F.max_by(value, held)
    carried = (
        buckets.groupBy(F.col(key).alias("__key"), "__bucket").agg(edge.alias("__edge"))
        .withColumnRenamed("__bucket", "__at")
        .withColumn("__carry", F.last("__edge", ignorenulls=True).over(across))
        .drop("__edge")
    )
    near = buckets.withColumn("__near", F.last(value, ignorenulls=True).over(within))
    return (
        near.join(carried, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__at")))
        .withColumn(out, F.coalesce("__near", "__carry"))
        .drop("__bucket", "__near", "__key", "__at", "__carry")
    )
