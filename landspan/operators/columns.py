"""Load-time column operators: names, geometry columns, feature ids, defaults."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landspan.functions.geometry import geometry_columns
from landspan.workspace import materialize


def quoted(name: str) -> str:
    """One identifier in back quotes."""
    return "`" + name.replace("`", "``") + "`"


def laundered(name: str) -> str:
    """Characters other than ASCII letters and digits become ``_``; lower case."""
    return re.sub("[^a-zA-Z0-9]", "_", name).lower()


def launder(df: DataFrame, keep_names: bool = False) -> DataFrame:
    """Launder every column name; two names that become equal are an error."""
    if keep_names:
        return df
    names = [laundered(name) for name in df.columns]
    clash = [name for name, uses in Counter(names).items() if uses > 1]
    if clash:
        raise ValueError(f"column names collide after laundering: {clash}")
    # Through the schema, so that field metadata (keys, defaults) stays attached.
    return df.select(
        [
            F.col(quoted(old.name)).alias(new, metadata=old.metadata)
            for old, new in zip(df.schema.fields, names)
        ]
    )


def attributes_only(df: DataFrame) -> DataFrame:
    """Drop every geometry column; Catalyst then leaves it out of the scan."""
    return df.drop(*geometry_columns(df))


def rename_geometry(df: DataFrame, name: str | None) -> DataFrame:
    """Name the geometry column; None keeps the original name."""
    geoms = geometry_columns(df)
    if name is None or not geoms:
        return df
    if len(geoms) > 1:
        raise ValueError(f"several geometry columns, cannot name one: {geoms}")
    return df.withColumnRenamed(geoms[0], name)


def add_feature_id(df: DataFrame, name: str = "gid", order_by: list[str] | None = None) -> DataFrame:
    """Dense feature id 1..n in front of the other columns.

    Rows are counted per partition and each partition starts where the one before it
    ends, so no task sees more than its own rows.  ``order_by`` range-partitions and
    sorts first; a row number breaks ties there, so a group of equal keys spreads over
    several partitions.  The rows are written once, by columns; a row's number is its place in its
    file and the sizes of the files before it, hence counts and ids always come from the same rows.
    """
    if name in df.columns:
        raise ValueError(f"column {name} already exists")
    columns = df.columns
    rows = df
    if order_by:
        rows = rows.withColumn("__tie", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(*order_by, "__tie")
        rows = rows.sortWithinPartitions(*order_by, "__tie").drop("__tie")
    stored = materialize(rows, "ids")
    # Files are named by the partition that wrote them.
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    seen = stored.select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__row"))
    counts = seen.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per partition: a single-task window over it is bounded by their number.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    gid = (F.col("__at") + F.col("__row") + 1).cast("long").alias(name)
    # The offsets hold one row per partition, so broadcasting them is bounded.
    return seen.join(F.broadcast(offsets), "__part").select(gid, *[F.col(quoted(c)) for c in columns])


def set_default(spark: SparkSession, table: str, column: str, default: str) -> None:
    """Default (a SQL literal) for later inserts; existing rows keep their values."""
    target = ".".join(quoted(part) for part in table.split(".", 1))
    spark.sql(f"ALTER TABLE {target} ALTER COLUMN {quoted(column)} SET DEFAULT {default}")
