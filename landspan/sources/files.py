"""Listing files and spreading the work on them over tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.workspace import pinned

# Tasks one read is spread over at most; more pieces than that share tasks.
MAX_TASKS = 50_000
# Tasks a core gets before small pieces share them, and pieces of one such task at most.
TASKS_PER_CORE, SHARED = 8, 256


def _resolve(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(local) if "://" in local else (pafs.LocalFileSystem(), local)


def open_file(path: str):
    """Random-access handle on a local path or any URI Arrow knows."""
    system, inner = _resolve(path)
    return system.open_input_file(inner)


def read_at(path: str, start: int, size: int) -> bytes:
    """``size`` bytes from ``start``; fewer at the end of the file."""
    with open_file(path) as handle:
        handle.seek(start)
        return handle.read(size)


def listing(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """``(path, length)`` of a file, or of the files below a folder with one of the suffixes.

    Suffixes match in any case; a file that is named itself is taken whatever its suffix.
    Only names and sizes are read: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = "/" + re.sub(r"^\w+:/*(?:[^/]*(?<=:\d)\d*/)?", "", path).strip("/")
    fits = F.lower("path").rlike(rf"\.(?:{'|'.join(suffixes)})$")
    return files.select("path", "length").where(fits | F.col("path").endswith(named))


def first_path(files: DataFrame, path: str) -> str:
    """Smallest path of a listing; an empty one is an error."""
    name = files.agg(F.min("path")).first()[0]
    if name is None:
        raise FileNotFoundError(f"no matching file at {path}")
    return name


def spread(pieces: DataFrame, *order: str, together: int = 1) -> DataFrame:
    """Pieces of work, spread evenly over tasks, each piece whole.

    ``together``: how many pieces are worth a task of their own. As long as all cores have several tasks,
    that many neighbours share one, ``SHARED`` at most, so the number of tasks follows the work and not the
    number of small pieces. The list is pinned and counted first: an explicit number of partitions keeps
    adaptive execution from merging rows that are tiny here but stand for a lot of reading.
    """
    listed = pinned(pieces)
    count = listed.count()
    cores = listed.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-count // max(1, min(together, SHARED))), min(count, TASKS_PER_CORE * cores))
    return listed.repartitionByRange(max(1, min(tasks, MAX_TASKS)), *order)


def write_files(rows: DataFrame, folder: str, content: Callable[[dict], dict[str, bytes]]) -> int:
    """Write the files of every row, as ``content`` names them (name -> bytes); their number.

    Tasks write the files of their own rows; writing one again replaces it.
    """

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _resolve(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            written = 0
            for row in frame.to_dict("records"):
                for name, data in content(row).items():
                    with system.open_output_stream(f"{base}/{name}") as out:
                        out.write(data)
                    written += 1
            yield pd.DataFrame({"written": [written]})

    return rows.mapInPandas(put, "written long").agg(F.sum("written")).first()[0] or 0
