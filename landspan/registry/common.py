"""Scratch schemas of the registered queries."""

import uuid

from landspan.operators import tables
from landspan.workspace import scratch_path


def scratch_schema(spark, label: str) -> str:
    """A new schema whose tables lie in the shared folder."""
    name = f"scratch_{label}_{uuid.uuid4().hex}"
    tables.ensure_schemas(spark, [name], scratch_path(spark, label))
    return name


def published(spark, table: str):
    """A table written before."""
    return spark.table(tables.sql_name(table))
