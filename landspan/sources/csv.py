"""CSV loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.sources import csv_dialect, csv_records
from landspan.workspace import materialize


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str = ",",
    multi_line: bool = False, encoding: str = "UTF-8",
) -> DataFrame:
    """Rows of CSV files with a header; types are inferred unless a schema is given.

    Inference reads the data once more, so a known schema halves the scan.
    With ``multi_line`` quoted values may hold line breaks; a file is then read by one task.
    """
    reader = spark.read.option("header", "true").option("sep", separator).option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("encoding", encoding)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", "true").csv(path)


# Kinds a column may have, tried in this order, with what must hold of every value.
_KINDS = {
    "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
    "bigint": lambda c: c.try_cast("bigint").isNotNull() & ~F.trim(c).rlike(r"[^-+0-9]"),
    "double": lambda c: c.try_cast("double").isNotNull() & F.trim(c).rlike(r"^[-+.0-9eE]+$"),
    "date": lambda c: c.try_cast("date").isNotNull() & c.rlike(r"^\d{4}-\d\d-\d\d$"),
    "timestamp_ntz": lambda c: c.try_cast("timestamp_ntz").isNotNull() & c.rlike(
        r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?$"),
    "timestamp": lambda c: c.try_cast("timestamp").isNotNull() & c.rlike(
        r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[-+]\d\d:?\d\d)$"),
}


def read_csv_as_found(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str | None = None,
    quote: str | None = None, header: bool | None = None, encoding: str = "UTF-8",
    range_bytes: int = csv_records.RANGE_BYTES,
) -> DataFrame:
    """Rows of CSV files whose dialect is found out; parts that are given hold.

    Separator, quote and header are voted on over the first bytes of a few files. The dialect is
    then proved on all records: each must have as many fields as the vote says, and every file the
    same header; the next dialect is tried otherwise, and none that holds is an error. Quoted values
    may hold line breaks, and large files are still read by many tasks. Values are written once as
    text; columns get the narrowest kind that all their values have, unless a schema is given,
    whose names then replace the header's. Columns without a header are column0, column1, ...
    """
    sampled = csv_records.samples(spark, path, encoding, csv_dialect.SAMPLE_BYTES, csv_dialect.SAMPLE_FILES)
    if not sampled:
        raise FileNotFoundError(f"no CSV file with content at {path}")
    problem = "no dialect has records of one width"
    for dialect in csv_dialect.candidates(sampled, separator, quote, header):
        rows = csv_records.split(spark, path, dialect.separator, dialect.quote, encoding, range_bytes)
        found = materialize(csv_records.fields(rows, dialect), "csv-fields")
        problem = _refuted(found, dialect)
        if problem is None:
            return _typed(found, dialect, schema)
    raise ValueError(f"{path}: {problem}")


def _refuted(found: DataFrame, dialect: csv_dialect.Dialect) -> str | None:
    """What shows that the dialect is not that of all files."""
    if odd := found.where("odd").select("path", "offset").first():
        return f"the record at byte {odd['offset']} of {odd['path']} does not have {dialect.width} fields"
    if dialect.names is None:
        return None
    heads = found.where("offset = 0").agg(F.count_distinct("record").alias("n"), F.max("path").alias("path")).first()
    return f"files have {heads['n']} different headers" if heads["n"] > 1 else None


def _typed(found: DataFrame, dialect: csv_dialect.Dialect, schema: T.StructType | str | None) -> DataFrame:
    if dialect.names is not None:
        found = found.where("offset > 0")
    texts = [F.col(f"c{i}") for i in range(dialect.width)]
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if len(wanted) != dialect.width:
            raise ValueError(f"the schema has {len(wanted)} columns, the files {dialect.width}")
        return found.select([c.try_cast(f.dataType).alias(f.name) for c, f in zip(texts, wanted)])
    misses = [F.count_if(c.isNotNull() & ~F.coalesce(fits(c), F.lit(False))) for c in texts for fits in _KINDS.values()]
    *counts, = found.agg(*[m.alias(f"m{i}") for i, m in enumerate(misses)],
                         *[F.count(c).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    out, n = [], len(_KINDS)
    for i, (text, name) in enumerate(zip(texts, dialect.columns)):
        fitting = [kind for kind, miss in zip(_KINDS, counts[n * i:n * i + n]) if miss == 0]
        kind = fitting[0] if fitting and counts[n * len(texts) + i] else "string"
        out.append((F.trim(text) if kind in ("boolean", "bigint", "double") else text).cast(kind).alias(name))
    return found.select(out)
