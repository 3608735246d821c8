"""Tables of DuckDB files, read by row-id ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from landspan.functions import wkb
from landspan.sources.files import first_path, listing, spread

# Rows that are worth a task.
ROWS_PER_TASK = 1_000_000
# DuckDB types without an equal in Spark, and what they are read as.
CASTS = {
    "HUGEINT": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(20,0)",
    "UINTEGER": "BIGINT", "USMALLINT": "INTEGER", "UTINYINT": "SMALLINT",
    "UUID": "VARCHAR", "TIME": "VARCHAR", "TIME WITH TIME ZONE": "VARCHAR",
    "INTERVAL": "VARCHAR", "BIT": "VARCHAR", "JSON": "VARCHAR",
    "TIMESTAMP_S": "TIMESTAMP", "TIMESTAMP_MS": "TIMESTAMP", "TIMESTAMP_NS": "TIMESTAMP",
}
# Field metadata keys for what the source declares about a column.
NOT_NULL, DEFAULT, KEY = "not_null", "default", "primary_key"


def _connect(path: str):
    import duckdb

    local = re.sub(r"^file:/*", "/", path)
    if "://" in local:
        raise ValueError(f"DuckDB opens mounted files only, not {path}")
    # Spark spreads the ranges over cores, so one task is one thread.
    return duckdb.connect(local, read_only=True, config={"threads": 1})


def _dotted(table: str) -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in table.split("."))


def _selected(name: str, kind: str) -> str:
    column = '"' + name.replace('"', '""') + '"'
    if kind.startswith("GEOMETRY"):
        return f"st_aswkb({column}) AS {column}"
    if kind.startswith("ENUM"):
        return f"CAST({column} AS VARCHAR) AS {column}"
    return f"CAST({column} AS {CASTS[kind]}) AS {column}" if kind in CASTS else column


def _batches(connection, query: str, rows: int):
    relation = connection.sql(query)
    arrow = getattr(relation, "to_arrow_reader", None) or relation.fetch_arrow_reader
    return arrow(rows)


def _describe(path: str, table: str) -> list[tuple]:
    with _connect(path) as connection:
        return connection.execute(f"PRAGMA table_info('{_dotted(table)}')").fetchall()


def _ranges(table: str, rows_per_task: int):
    """Row-id ranges of every listed file; a view has no row ids and stays whole."""
    import duckdb

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with _connect(path) as connection:
                    try:
                        query = f"SELECT max(rowid) FROM {_dotted(table)}"
                        top = connection.execute(query).fetchall()[0][0]
                    except duckdb.BinderException:
                        found.append((path, None, None))
                        continue
                last = -1 if top is None else top
                for low in range(0, last + 1, rows_per_task):
                    found.append((path, low, low + rows_per_task - 1))
            names = ("path", "low", "high")
            types = (pa.string(), pa.int64(), pa.int64())
            columns = [
                pa.array([row[i] for row in found], kind) for i, kind in enumerate(types)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return find


def _rows(table: str, select: str, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                where = "" if piece["low"] is None else (
                    f" WHERE rowid BETWEEN {piece['low']} AND {piece['high']}"
                )
                with _connect(piece["path"]) as connection:
                    query = f"SELECT {select} FROM {_dotted(table)}{where}"
                    for rows in _batches(connection, query, 10_000):
                        yield pa.RecordBatch.from_arrays(rows.columns, schema=schema)

    return read


def read_duckdb(
    spark: SparkSession, path: str, table: str, columns: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK, with_geometry: bool = True,
) -> DataFrame:
    """All columns (or the wanted ones) of a table, from one file or a folder of files.

    Every file is cut into row-id ranges and every range is one task.  Not-null, default
    and key flags are kept as field metadata; GEOMETRY columns arrive as geometry structs, or are not
    read at all without ``with_geometry``.
    """
    files = listing(spark, path, "duckdb", "ddb", "db")
    info = _describe(first_path(files, path), table)
    wanted = [c for c in info if (columns is None or c[1] in columns)
              and (with_geometry or not c[2].startswith("GEOMETRY"))]
    select = ", ".join(_selected(name, kind) for _, name, kind, *_ in wanted)
    with _connect(first_path(files, path)) as connection:
        query = f"SELECT {select} FROM {_dotted(table)} LIMIT 0"
        arrow = _batches(connection, query, 1).schema
    # Plain types only: extension names of the file format do not travel to Spark.
    arrow = pa.schema([pa.field(f.name, getattr(f.type, "storage_type", f.type)) for f in arrow])
    schema = from_arrow_schema(arrow, prefer_timestamp_ntz=True)
    ranges = files.select("path").mapInArrow(
        _ranges(table, rows_per_task), "path string, low long, high long"
    )
    rows = spread(ranges, "path", "low", together=ROWS_PER_TASK // rows_per_task).mapInArrow(_rows(table, select, arrow), schema)
    for _, name, kind, *_ in wanted:
        if kind.startswith("GEOMETRY"):
            rows = wkb.decode(rows, name)
    flags = {
        name: {NOT_NULL: bool(required), KEY: bool(key)} | ({DEFAULT: default} if default else {})
        for _, name, _, required, default, key in wanted
    }
    return rows.select(
        [F.col(f"`{name}`").alias(name, metadata=flags[name]) for name in rows.columns]
    )


def declared(df: DataFrame, flag: str) -> dict[str, object]:
    """Columns whose field metadata carries a (true) flag, with its value."""
    fields: list[T.StructField] = df.schema.fields
    return {f.name: f.metadata[flag] for f in fields if f.metadata.get(flag)}
