"""Log levels of a live stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landspan.operators.journal import line_level, starts_traceback


def classify_stream(
    lines: DataFrame, run: str, order: str, text: str, folder: str, trigger: dict | None = None, **options: str
) -> StreamingQuery:
    """Write every line of a stream with its ``level`` below ``folder``.

    The only state is the first traceback header of each run.  A micro-batch finds its
    own headers with a partially aggregated minimum, merges them into the table the batch before it
    left, and joins its lines with the earliest header per run; so one very long run is no single task, and
    what a batch reads grows with the runs, not with the batches.  Both writes replace the folder of
    their batch id: a repeated batch leaves one copy.  ``trigger`` is what Spark's trigger takes; by
    default everything there is read and the stream ends.
    """
    heads_path, lines_path = f"{folder}/headers", f"{folder}/lines"

    def classify(batch: DataFrame, batch_id: int) -> None:
        fresh = (
            batch.where(starts_traceback(F.col(text)))
            .groupBy(F.col(run).alias("__run")).agg(F.min(order).alias("__first"))
        )
        read = batch.sparkSession.read.schema(fresh.schema)
        if batch_id:
            known = read.parquet(f"{heads_path}/batch={batch_id - 1}")
            fresh = known.unionByName(fresh).groupBy("__run").agg(F.min("__first").alias("__first"))
        fresh.write.mode("overwrite").parquet(f"{heads_path}/batch={batch_id}")
        first = read.parquet(f"{heads_path}/batch={batch_id}")
        joined = batch.join(first, batch[run] == first["__run"], "left")
        inside = F.coalesce(F.col(order) > F.col("__first"), F.lit(False))
        levels = joined.withColumn("level", line_level(F.col(text), inside))
        levels.drop("__run", "__first").write.mode("overwrite").parquet(
            f"{lines_path}/batch={batch_id}"
        )

    return (
        lines.writeStream.foreachBatch(classify)
        .option("checkpointLocation", f"{folder}/checkpoint").options(**options)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def classified(spark, folder: str) -> DataFrame:
    """The lines written so far."""
    return spark.read.parquet(f"{folder}/lines").drop("batch")
