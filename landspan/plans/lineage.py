"""Lineage of a whole table of SQL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landspan.operators import script_events, script_text
from landspan.workspace import materialize


def lineage(
    scripts: DataFrame, known_functions: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(objects, violations) of ``scripts(script_id, sql)``.

    Objects are ``(script_id, role, schema, name, type)`` with role created or
    dependency; a script with a violation has none.  The extracted events are written
    once, because several aggregations read them.
    """
    builtins = script_text.builtin_functions(scripts.sparkSession) + (known_functions or [])
    stmts = materialize(script_text.statements(scripts), "statements")
    events = materialize(script_text.object_events(stmts, builtins), "events")
    spans = materialize(script_events.transactions(events), "spans")
    errors = script_text.form_errors(stmts).unionByName(script_events.violations(spans))
    return script_events.report(spans, [errors]), errors
