"""Analytics over the run journal and over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a log line, in lower case.
ERROR_MARK = "error"
WARNING_MARK = "warn"
TRACEBACK_MARK = "traceback (most recent call last)"


def manifest(journal: DataFrame) -> DataFrame:
    """Latest completion per node: ``(node_id, completed)``."""
    return journal.groupBy("node_id").agg(F.max("completed").alias("completed"))


def local_time(df: DataFrame, column: str, zone: str) -> DataFrame:
    """Convert a UTC time to wall time in ``zone``."""
    return df.withColumn(column, F.from_utc_timestamp(column, zone))


def line_level(text: Column, in_traceback: Column) -> Column:
    """Level of one line, given whether a traceback began on an earlier one."""
    lower = F.lower(text)
    return (
        F.when(in_traceback | lower.contains(ERROR_MARK), "error")
        .when(lower.contains(WARNING_MARK), "warning")
        .when(lower.contains(TRACEBACK_MARK), "error")
        .otherwise("info")
    )


def starts_traceback(text: Column) -> Column:
    """Whether a line switches its run to "everything after is an error"."""
    lower = F.lower(text)
    return (
        lower.contains(TRACEBACK_MARK)
        & ~lower.contains(ERROR_MARK)
        & ~lower.contains(WARNING_MARK)
    )


def log_levels(lines: DataFrame, run: str, order: list[str], text: str) -> DataFrame:
    """Add ``level`` (error, warning, info) to every line of every run.

    The flag is sticky, so a line is inside a traceback exactly when it comes after the
    first header of its run: one minimum per run, combined map-side, joined back.  No
    task needs all lines of a run, however long one run is.
    """
    place = F.struct(*order)
    first = (
        lines.where(starts_traceback(F.col(text)))
        .groupBy(F.col(run).alias("__run"))
        .agg(F.min(place).alias("__first"))
    )
    joined = lines.join(first, lines[run] == first["__run"], "left")
    inside = F.coalesce(place > F.col("__first"), F.lit(False))
    return joined.withColumn("level", line_level(F.col(text), inside)).drop("__run", "__first")
