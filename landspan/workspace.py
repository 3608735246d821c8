"""Shared scratch space: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@functools.cache
def _one_machine_root() -> str:
    return tempfile.mkdtemp(prefix="landspan-")


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _one_machine_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root; never reused."""
    path = f"{shared_root(spark)}/landspan/{label}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    return path


# Paths given out while `settled` waits for its frame.
_OPEN: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write the frame that ``make`` returns, and delete what was written on the way to it."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        frame = make()
    finally:
        _OPEN.remove(paths)
    out = materialize(frame, label)
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return out


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut in the lineage.

    The copy survives the loss of executors, keeps Parquet statistics and column
    pruning, and gives every later reader the same rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: same rows in the same partitions for every later reader."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


# Rows of a frame that may still be sent through the driver for a join.
BROADCAST_ROWS = 20_000


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join in a loop, where broadcasts of each round add up: with many rows, both are shuffled."""
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


class Rounds:
    """Rows produced by an iterative operator, one written batch per round.

    The plan that reads all rounds is one scan of one folder, so it does not grow
    with the number of rounds.
    """

    def __init__(self, spark: SparkSession, label: str, schema: T.StructType):
        self._spark = spark
        self._path = scratch_path(spark, label)
        self._schema = schema
        self._count = 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write one round and return it re-read.

        A frame read from files has their true size as its statistic, so Catalyst
        broadcasts a small round by itself and shuffles for a large one.
        """
        path = f"{self._path}/round={self._count:06d}"
        df.select(self._schema.names).write.parquet(path)
        self._count += 1
        return self._spark.read.schema(self._schema).parquet(path)

    def all(self) -> DataFrame:
        """Rows of every round so far."""
        return self._spark.read.schema(self._schema).parquet(self._path).select(self._schema.names)
