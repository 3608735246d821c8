"""Queries over the run journal, run logs and freshness."""

from pyspark.sql import functions as F

from landspan.operators import graph, tables
from landspan.operators import journal as jrn
from landspan.plans import derived, freshness
from landspan.plans.derived import table
from landspan.registry.common import published, scratch_schema
from landspan.streaming.logs import classified, classify_stream
from landspan.workspace import scratch_path


def _events_graph(spark, folder):
    events = table(spark, folder, "events")
    nodes = derived.user_nodes(events)
    journal = derived.user_journal(derived.ran(events))
    return nodes, derived.halving_edges(events.select("user_id"), "user_id"), journal


def h_manifest(spark, folder):
    return jrn.manifest(derived.user_journal(table(spark, folder, "events")))


def h_local_time(spark, folder):
    """Wall time in a zone with summer time; completions are spread beyond its change."""
    spread = h_manifest(spark, folder).withColumn(
        "completed", F.expr("completed + make_dt_interval(CAST(node_id AS INT) % 365)"))
    return jrn.local_time(spread, "completed", "Pacific/Auckland")


def h_outdated(spark, folder):
    return freshness.outdated(*_events_graph(spark, folder))


def h_worklist(spark, folder):
    nodes, edges, journal = _events_graph(spark, folder)
    stale = freshness.outdated(nodes, edges, journal)
    return freshness.worklist(
        graph.select_nodes(nodes, "1*"), graph.levels(nodes, edges), stale
    ).select("node_id", "level")


def h_log_levels(spark, folder):
    lines = derived.log_lines(table(spark, folder, "events"))
    return jrn.log_levels(lines, "run_id", ["ts", "event_id"], "text").select(
        "run_id", "event_id", "level"
    )


def h_log_stream(spark, folder):
    """The same lines as a stream of files."""
    source, target = scratch_path(spark, "log-source"), scratch_path(spark, "log-stream")
    lines = derived.log_lines(table(spark, folder, "events"))
    lines = lines.withColumn("line_no", F.unix_micros(F.col("ts").cast("timestamp")))
    last = lines.agg(F.max("event_id")).first()[0] or 0
    for quarter in range(4):
        # The lines of the next quarter arrive; the stream goes on where it stopped.
        part = lines.where(F.expr(f"event_id * 4 DIV {last + 1} = {quarter}"))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(lines.schema).parquet(source)
        classify_stream(stream, "run_id", "line_no", "text", target).awaitTermination()
    return classified(spark, target).select("run_id", "event_id", "level")


def d_journal_append(spark, folder):
    schema = scratch_schema(spark, "journal")
    name = f"{schema}.run_journal"
    records = derived.user_journal(table(spark, folder, "events"))
    tables.append_journal(records.where("hostname < 'host-4'"), name)
    tables.append_journal(records.where("hostname >= 'host-4'"), name)
    return published(spark, name).groupBy("hostname").agg({"node_id": "count"}).withColumnRenamed(
        "count(node_id)", "records"
    )


QUERIES = {f.__name__: f for f in (
    h_manifest, h_local_time, h_outdated, h_worklist, h_log_levels, h_log_stream,
    d_journal_append,
)}

_GRAPH = """
    nodes AS (SELECT DISTINCT user_id AS n FROM events),
    edges AS (SELECT n AS child, n // 2 AS parent FROM nodes WHERE n % 3 <> 0 AND n > 1),
    done AS (SELECT user_id AS n, max(ts) AS t FROM events WHERE user_id % 11 <> 5 GROUP BY 1),
    seeds AS (
        SELECT n FROM nodes WHERE n NOT IN (SELECT n FROM done)
        UNION
        SELECT e.child FROM edges e JOIN done c ON c.n = e.child LEFT JOIN done p ON p.n = e.parent
        WHERE p.n IS NULL OR c.t < p.t
    ),
    stale AS (
        SELECT n FROM seeds
        UNION
        SELECT e.child FROM stale s JOIN edges e ON e.parent = s.n
    )
"""
ORACLES = {
    "h_manifest": """
        SELECT CAST(user_id AS VARCHAR) AS node_id, max(ts) AS completed
        FROM events GROUP BY 1""",
    "h_local_time": """
        SELECT CAST(user_id AS VARCHAR) AS node_id,
            timezone('Pacific/Auckland',
                timezone('UTC', max(ts) + to_days(CAST(user_id % 365 AS INTEGER)))) AS completed
        FROM events GROUP BY user_id""",
    "h_outdated": f"WITH RECURSIVE {_GRAPH} SELECT CAST(n AS VARCHAR) AS node_id FROM stale",
    "h_worklist": f"""
        WITH RECURSIVE {_GRAPH},
        walk AS (
            SELECT n, 0 AS level FROM nodes WHERE n NOT IN (SELECT child FROM edges)
            UNION ALL
            SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.n
        )
        SELECT CAST(n AS VARCHAR) AS node_id, CAST(max(level) AS INTEGER) AS level
        FROM walk WHERE n IN (SELECT n FROM stale) AND CAST(n AS VARCHAR) LIKE '1%'
        GROUP BY n""",
    "h_log_levels": """
        WITH lines AS (
            SELECT user_id AS run_id, event_id, ts,
                lower(CASE WHEN event_id % 97 = 0 THEN 'Traceback (most recent call last):'
                    ELSE event_type END) AS txt
            FROM events
        ), flagged AS (
            SELECT *, coalesce(max(CAST(txt LIKE '%traceback (most recent call last)%'
                    AND txt NOT LIKE '%error%' AND txt NOT LIKE '%warn%' AS INTEGER)) OVER (
                PARTITION BY run_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sticky
            FROM lines
        )
        SELECT run_id, event_id,
            CASE WHEN sticky = 1 OR txt LIKE '%error%' THEN 'error'
                WHEN txt LIKE '%warn%' THEN 'warning'
                WHEN txt LIKE '%traceback (most recent call last)%' THEN 'error'
                ELSE 'info' END AS level
        FROM flagged""",
    "d_journal_append": """
        SELECT 'host-' || CAST(event_id % 8 AS VARCHAR) AS hostname, count(*) AS records
        FROM events GROUP BY 1""",
}
ORACLES["h_log_stream"] = ORACLES["h_log_levels"]
