"""Publishing tables: schemas, replacement, spatial layout, the run journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.operators import checks, layout
from landspan.operators.columns import quoted

JOURNAL_SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("started", T.TimestampType(), False),
        T.StructField("completed", T.TimestampType(), False),
        T.StructField("db_user", T.StringType(), False),
        T.StructField("hostname", T.StringType(), False),
        T.StructField("engine_version", T.StringType(), False),
        T.StructField("repo_revision", T.StringType(), True),
    ]
)


def split_name(table: str) -> tuple[str, str]:
    """(schema, table), split at the first dot; the dot is required."""
    schema, dot, name = table.partition(".")
    if not dot or not schema or not name:
        raise ValueError(f"expected <schema>.<table>, got {table!r}")
    return schema, name


def sql_name(table: str) -> str:
    """Quoted two-part name; dots after the first belong to the table."""
    schema, name = split_name(table)
    return f"`{schema}`.`{name}`"


def ensure_schemas(spark: SparkSession, schemas: list[str], location: str | None = None) -> None:
    """Create the schemas that are missing, each below ``location`` when one is given."""
    for schema in schemas:
        where = f" LOCATION '{location}/{schema}'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`{where}")


def replace_table(df: DataFrame, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Replace ``schema.table`` with the rows of ``df``; returns the new table.

    The rows go to a sibling table that is renamed at the end, so ``df`` may read the
    table it replaces.  A reader that arrives between drop and rename misses the table.
    """
    spark = df.sparkSession
    schema, name = split_name(table)
    ensure_schemas(spark, [schema])
    staged = f"`{schema}`.`{name}__next`"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    df.write.mode("overwrite").saveAsTable(staged)
    return publish(spark, f"{schema}.{name}__next", table, properties)


def publish(
    spark: SparkSession, staged: str, table: str, properties: dict[str, str] | None = None
) -> DataFrame:
    """Rename a finished staging table over the destination."""
    for key, value in (properties or {}).items():
        spark.sql(f"ALTER TABLE {sql_name(staged)} SET TBLPROPERTIES ('{key}' = '{value}')")
    spark.sql(f"DROP TABLE IF EXISTS {sql_name(table)}")
    spark.sql(f"ALTER TABLE {sql_name(staged)} RENAME TO {sql_name(table)}")
    return spark.table(sql_name(table))


def index_geometry(spark: SparkSession, table: str, column: str) -> bool:
    """Lay a table out along ``column``; False when that was already done.

    Bounds and key of an earlier layout go; attributes of the same names stay, and the new
    columns get the name of the geometry as a prefix.
    """
    rows = spark.table(sql_name(table))
    done = layout.layout_of(spark, sql_name(table))
    if done:
        old, _, key = done.partition(":")
        if old == column:
            return False
        prefix = key.removesuffix("morton")
        rows = rows.drop(*[f"{prefix}{n}" for n in (*layout.BOX, "morton")])
    prefix = layout.prefix_for(rows.columns, column)
    boxed = layout.add_bounds(rows, column, prefix)
    clustered = layout.cluster(boxed, layout.frame_of(boxed, prefix), prefix)
    replace_table(clustered, table, {layout.LAYOUT_PROPERTY: layout.marker(column, prefix)})
    return True


def index_geometries(spark: SparkSession, table: str, columns: list[str]) -> bool:
    """Lay a table out along several geometry columns at once; False when that was already done.

    Each gets its bounds, with its name in front, and a box of any of them skips data.
    """
    rows = spark.table(sql_name(table))
    done = layout.layout_of(spark, sql_name(table)) or ""
    places, _, key = done.rpartition(":")
    if "=" in places:
        known = dict(pair.split("=") for pair in places.split(","))
        if set(known) == set(columns):
            return False
        rows = rows.drop(key, *[f"{prefix}{n}" for prefix in known.values() for n in layout.BOX])
    elif done:
        prefix = key.removesuffix("morton")
        rows = rows.drop(*[f"{prefix}{n}" for n in (*layout.BOX, "morton")])
    clustered, mark = layout.lay_out(rows, columns)
    replace_table(clustered, table, {layout.LAYOUT_PROPERTY: mark})
    return True


def init_journal(spark: SparkSession, table: str) -> None:
    """Create the journal table if it is missing."""
    ensure_schemas(spark, [split_name(table)[0]])
    fields = ", ".join(
        f"{quoted(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in JOURNAL_SCHEMA.fields
    )
    spark.sql(f"CREATE TABLE IF NOT EXISTS {sql_name(table)} ({fields}) USING parquet")


def run_records(
    runs: DataFrame, user: str, host: str, version: str, revision: str | None = None
) -> DataFrame:
    """Journal records of finished runs ``(node_id, started, completed)``, all by one process.

    Other columns are ignored.  ``revision`` is NULL outside a working copy.
    """
    given = {"db_user": user, "hostname": host, "engine_version": version, "repo_revision": revision}
    return runs.select("node_id", "started", "completed").select(
        "*", *[F.lit(v).cast("string").alias(n) for n, v in given.items()]
    ).select(JOURNAL_SCHEMA.names)


def append_journal(records: DataFrame, table: str) -> None:
    """Append a batch of run records, one write for the whole batch.

    A NULL in a column that must have a value is an error, and nothing is appended.
    """
    init_journal(records.sparkSession, table)
    checks.require_not_null(records, [f.name for f in JOURNAL_SCHEMA.fields if not f.nullable])
    records.select(JOURNAL_SCHEMA.names).write.mode("append").insertInto(sql_name(table))
