"""What a script creates and needs, from a table of object events.

``events(script_id, stmt, action, schema, name, type, temp)``, one row per object a
statement touches; action is create, reference, drop, insert, update, alter, analyze,
begin, commit or rollback.  ``stmt`` orders the statements of a script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.operators.scans import nearest

OBJECT = ["schema", "name", "type"]
CONTROL = ["begin", "commit", "rollback"]


def transactions(events: DataFrame) -> DataFrame:
    """Add ``tx`` (statement that opened it, NULL outside) and ``outcome`` to every event.

    ``outcome`` is the statement kind that ends the transaction: commit, rollback, or
    NULL when it is never closed.
    """
    control = events.where(F.col("action").isin(CONTROL)).select(
        "script_id", "stmt", "action", F.col("action").alias("__self")
    )
    ends = nearest(control, "script_id", "stmt", "__self", "__next", ahead=True)
    marks = ends.select(
        F.col("script_id").alias("__script"), F.col("stmt").alias("__stmt"),
        F.when(F.col("action") == "begin", F.struct(
            F.col("stmt").alias("tx"),
            F.when(F.col("__next") != "begin", F.col("__next")).alias("outcome"),
        )).otherwise(F.struct(
            F.lit(None).cast("long").alias("tx"), F.lit(None).cast("string").alias("outcome"),
        )).alias("__mark"),
    )
    marked = events.join(
        marks,
        (F.col("script_id") == F.col("__script")) & (F.col("stmt") == F.col("__stmt"))
        & F.col("action").isin(CONTROL),
        "left",
    ).drop("__script", "__stmt")
    known = nearest(marked, "script_id", "stmt", "__mark", "__open")
    # A control statement shows the transaction it opens; others the one they are in.
    span = F.when(F.col("action") == "begin", F.col("__mark")).otherwise(F.col("__open"))
    return known.select(
        *events.columns, span["tx"].alias("tx"), span["outcome"].alias("outcome")
    )


def transaction_errors(events: DataFrame) -> DataFrame:
    """Nested, unopened and unclosed transactions: ``(script_id, stmt, reason)``."""
    control = events.where(F.col("action").isin(CONTROL)).select(
        "script_id", "stmt", "action", F.col("action").alias("__self")
    )
    both = nearest(control, "script_id", "stmt", "__self", "__before")
    both = nearest(both, "script_id", "stmt", "__self", "__after", ahead=True)
    opens, was_open = F.col("action") == "begin", F.col("__before") == "begin"
    reasons = F.array_compact(F.array(
        F.when(opens & was_open, "begin inside a transaction"),
        F.when(opens & F.col("__after").isNull(), "transaction is never closed"),
        F.when(~opens & ~F.coalesce(was_open, F.lit(False)),
               F.concat(F.col("action"), F.lit(" outside a transaction"))),
    ))
    return both.select("script_id", "stmt", F.explode(reasons).alias("reason"))


def _permanent(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("action") == "create") & ~F.col("temp"))


def _kept(spans: DataFrame) -> DataFrame:
    """Creations that last: outside any transaction, or in a committed one."""
    lasting = F.col("tx").isNull() | (F.col("outcome") == "commit")
    return (
        _permanent(spans).where(lasting)
        .groupBy("script_id", *OBJECT).agg(F.min("stmt").alias("made_at"))
    )


def _in_sight(spans: DataFrame, actions: list[str]) -> DataFrame:
    """Events of the given actions with ``kept_before`` and ``tx_before``.

    ``kept_before``: a lasting creation of the object came earlier.  ``tx_before``: a
    creation came earlier in the same transaction.
    """
    in_tx = (
        _permanent(spans).where("tx IS NOT NULL")
        .groupBy("script_id", *OBJECT, "tx").agg(F.min("stmt").alias("made_in_tx"))
    )
    asked = spans.where(F.col("action").isin(actions))
    return (
        asked.join(_kept(spans), ["script_id", *OBJECT], "left")
        .join(in_tx, ["script_id", *OBJECT, "tx"], "left")
        .withColumn("kept_before", F.coalesce(F.col("made_at") < F.col("stmt"), F.lit(False)))
        .withColumn("tx_before", F.coalesce(F.col("made_in_tx") < F.col("stmt"), F.lit(False)))
    )


def created(spans: DataFrame) -> DataFrame:
    """Objects a script leaves behind: lasting creations minus effective drops.

    A drop outside a transaction counts when a lasting creation came before it; a drop
    inside one counts when the same transaction created the object before and committed.
    Creating again after a drop does not bring the object back.
    """
    drops = _in_sight(spans, ["drop"])
    outside = F.col("tx").isNull() & F.col("kept_before")
    inside = F.col("tx").isNotNull() & F.col("tx_before") & (F.col("outcome") == "commit")
    gone = drops.where(outside | inside).select("script_id", *OBJECT)
    keys = ["script_id", *OBJECT]
    return _kept(spans).select(keys).join(gone, keys, "left_anti")


def dependencies(spans: DataFrame) -> DataFrame:
    """Objects a script needs from elsewhere.

    References, analyzed objects and insert targets not created before, wherever they
    stand and whatever became of their transaction; minus temporary objects and lasting
    creations of the same script, before or after.
    """
    keys = ["script_id", *OBJECT]
    plain = spans.where(F.col("action").isin("reference", "analyze")).select(keys)
    unseen = F.col("action") == "insert"
    inserts = _in_sight(spans, ["insert"]).where(unseen & ~F.col("kept_before") & ~F.col("tx_before"))
    temps = spans.where((F.col("action") == "create") & F.col("temp")).select(keys)
    return (
        plain.unionByName(inserts.select(keys)).distinct()
        .join(temps, keys, "left_anti")
        .join(_kept(spans).select(keys), keys, "left_anti")
    )


def rule_violations(spans: DataFrame) -> DataFrame:
    """Alters and updates of objects the script did not create before."""
    unsupported = _in_sight(spans, ["alter", "update"]).where(
        ~F.col("kept_before") & ~F.col("tx_before")
    )
    reason = F.concat(F.col("action"), F.lit(" of an object not created before"))
    return unsupported.select("script_id", "stmt", reason.alias("reason"))


def violations(spans: DataFrame) -> DataFrame:
    """Everything that makes a script unusable: ``(script_id, stmt, reason)``."""
    return transaction_errors(spans).unionByName(rule_violations(spans))


def report(spans: DataFrame, errors: list[DataFrame]) -> DataFrame:
    """``(script_id, role, schema, name, type)`` of the scripts without a violation."""
    both = created(spans).withColumn("role", F.lit("created")).unionByName(
        dependencies(spans).withColumn("role", F.lit("dependency"))
    )
    broken = reduce(DataFrame.unionByName, [e.select("script_id") for e in errors]).distinct()
    return both.join(broken, "script_id", "left_anti").select("script_id", "role", *OBJECT)
