"""Recursive traversal with UNION (distinct) semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.workspace import Rounds, by_rows


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct rows of ``base`` and of ``step`` applied over and over to new rows only.

    Ends when a round brings nothing new, so cycles end too.  Every round is written to
    the shared folder, which keeps the plan the same size in every round.
    """
    start = base.distinct()
    found = Rounds(base.sparkSession, "recursion", start.schema)
    frontier = found.append(start)
    total = 0
    while rows := frontier.count():
        total += rows
        known = by_rows(found.all(), total).alias("known")
        fresh = step(by_rows(frontier, rows)).select(start.columns).distinct().alias("fresh")
        same = [F.col(f"fresh.`{c}`").eqNullSafe(F.col(f"known.`{c}`")) for c in start.columns]
        frontier = found.append(fresh.join(known, same, "left_anti"))
    return found.all()
