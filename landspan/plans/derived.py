"""Inputs that Spark derives from the given tables, for the registered queries and tests.

Graphs, journals, geometries, scripts and rasters are simple arithmetic on key columns, so
that plain SQL can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.functions import geometry as geo


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Graph and journal -----------------------------------------------------------------


def user_nodes(events: DataFrame) -> DataFrame:
    """One source node per user."""
    return events.select(
        F.col("user_id").cast("string").alias("node_id"), F.lit("source").alias("kind")
    ).distinct()


def halving_edges(ids: DataFrame, key: str) -> DataFrame:
    """Edge from k to its parent k div 2, none when k mod 3 = 0."""
    k = F.col(key)
    return ids.where((k % 3 != 0) & (k > 1)).select(
        k.cast("string").alias("child"), F.expr(f"{key} DIV 2").cast("string").alias("parent")
    ).distinct()


def ran(events: DataFrame) -> DataFrame:
    """Events without the users who never ran, those with key mod 11 = 5."""
    return events.where("user_id % 11 <> 5")


def user_journal(events: DataFrame) -> DataFrame:
    """One run record per event."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").cast("string").alias("node_id"),
        (ts - F.expr("INTERVAL 1 MINUTE")).alias("started"), ts.alias("completed"),
        F.lit("loader").alias("db_user"), F.concat(F.lit("host-"), F.col("event_id") % 8).alias("hostname"),
        F.lit("1.0").alias("engine_version"), F.lit(None).cast("string").alias("repo_revision"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """One log line per event; every 97th starts a traceback."""
    return events.select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.when(F.col("event_id") % 97 == 0, "Traceback (most recent call last):")
        .otherwise(F.col("event_type")).alias("text"),
    )


def key_objects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, owns, deps): a node per key, which needs the object of its foreign key."""
    plan = [
        ("region", "r_regionkey", None, None, "source"),
        ("nation", "n_nationkey", "region", "n_regionkey", "transform"),
        ("customer", "c_custkey", "nation", "c_nationkey", "transform"),
        ("orders", "o_orderkey", "customer", "o_custkey", "custom"),
    ]
    nodes, owns, deps = [], [], []
    for name, key, parent, foreign, kind in plan:
        rows = table(spark, folder, name)
        node = F.concat(F.lit(f"{name}."), F.col(key))
        nodes.append(rows.select(node.alias("node_id"), F.lit(kind).alias("kind")))
        obj = [F.lit(name).alias("schema"), F.concat(F.lit("t"), F.col(key)).alias("name"),
               F.lit("relation").alias("type")]
        owns.append(rows.select(node.alias("node_id"), *obj))
        if parent:
            need = [F.lit(parent).alias("schema"), F.concat(F.lit("t"), F.col(foreign)).alias("name"),
                    F.lit("relation").alias("type")]
            deps.append(rows.select(node.alias("node_id"), *need))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    return union(nodes), union(owns), union(deps)


# Geometry --------------------------------------------------------------------------


def customer_points(customer: DataFrame, srid: int = 4326) -> DataFrame:
    """A point per customer, spread over the globe by its key."""
    k = F.col("c_custkey")
    lon = F.lit(-180.0) + (k * 37 % 36000) / 100.0
    lat = F.lit(-80.0) + (k * 53 % 16000) / 100.0
    return customer.select("c_custkey", "c_nationkey", geo.point(lon, lat, srid=srid).alias("geom"))


def zone_points(customer: DataFrame) -> DataFrame:
    """A point per customer in longitudes 166 to 179 and latitudes -47 to -34."""
    k = F.col("c_custkey")
    lon = F.lit(166.0) + (k * 37 % 1300) / 100.0
    lat = F.lit(-47.0) + (k * 53 % 1300) / 100.0
    return customer.select("c_custkey", geo.point(lon, lat, srid=4326).alias("geom"))


def part_rectangles(part: DataFrame) -> DataFrame:
    """A rectangle per part, p_size by key mod 7 + 1; even keys have a hole of half a unit."""
    k = F.col("p_partkey")
    x, y = (k % 1000) * 100.0, F.floor(k / 1000) * 100.0
    w, h = F.col("p_size").cast("double"), (k % 7 + 1).cast("double")

    def ring(x0, y0, x1, y1, clockwise: bool):
        corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        corners = corners if clockwise else corners[::-1]
        return F.array(*[geo.vertex(a, b) for a, b in corners])

    outer = ring(x, y, x + w, y + h, True)
    hole = ring(x + 0.25, y + 0.25, x + 0.75, y + 0.75, False)
    rings = F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return part.select("p_partkey", "p_brand", geo.polygon(rings, 2193).alias("geom"))
