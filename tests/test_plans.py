"""Plans and skew: what reaches the scan, what is never in a plan, and hot keys."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from landspan.functions import geometry as geo
from landspan.operators import checks, columns, graph, journal, layout
from landspan.plans import derived


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    old = {}

    def put(key, value):
        old[key] = spark.conf.get(key)
        spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.set(key, value)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_box_filter_and_columns_reach_the_scan(spark, table, tmp_path, conf):
    boxed = layout.add_bounds(derived.part_rectangles(table("part")), "geom")
    boxed.write.parquet(str(tmp_path / "t"))
    conf("spark.sql.maxMetadataStringLength", "100000")
    found = layout.in_box(columns.attributes_only(spark.read.parquet(str(tmp_path / "t"))), (0.0, 0.0, 9.0, 9.0))
    plan = plan_of(found.select("p_partkey"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "LessThanOrEqual(xmin" in pushed and "GreaterThanOrEqual(ymax" in pushed
    assert "geom" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_manifest_reads_two_columns_and_combines_before_the_shuffle(spark, table):
    plan = plan_of(journal.manifest(derived.user_journal(table("events"))))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["ts", "user_id"]
    assert plan.count("partial_max") >= 1


@pytest.mark.parametrize("name", [
    "h_log_levels", "g_edges", "g_missing_owner", "g_render", "c_primary_key_composite",
    "e_update_from", "e_union_points", "b_reproject_3857", "b_reproject_2193",
])
def test_no_cross_join_and_no_python_in_relational_plans(name, spark, sf):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_sources_keep_the_rules():
    text = "".join(p.read_text() for p in Path(entry.__file__).parent.glob("landspan/**/*.py"))
    assert "local" + "Checkpoint" not in text and ".toPandas(" not in text and "crossJoin" not in text


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, many of them copies."""
    return spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("k"),
        (F.col("id") % 50).alias("v"))


def test_hot_groups_stay_whole(spark, hot, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    worst = checks.key_violations(hot, ["k"]).orderBy(F.desc("copies")).first()
    assert worst["k"] == 7 and worst["copies"] >= 10_000
    lines = hot.select("k", "id", F.when(F.col("id") == 15_000, "Traceback (most recent call last):")
                       .otherwise("x").alias("text"))
    levels = journal.log_levels(lines, "k", ["id"], "text").groupBy("k", "level").count().collect()
    late = hot.where("k = 7 AND id >= 15000").count()
    assert {(r["k"], r["level"]): r["count"] for r in levels}[(7, "error")] == late
    numbered = columns.add_feature_id(hot, "gid", ["k"])
    ids = numbered.agg(F.min("gid"), F.max("gid"), F.count_distinct("gid")).first()
    assert tuple(ids) == (1, 30_000, 30_000)
    parts = numbered.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2
    points = hot.select("k", geo.point(F.col("id"), F.col("v")).alias("g"))
    spots = geo.distinct_points(points.where("k = 7"), ["k"], "g")
    assert spots.count() == points.where("k = 7").count()
    owns = hot.select(F.col("id").cast("string").alias("node_id"), F.lit("s").alias("schema"),
                      F.col("k").cast("string").alias("name"), F.lit("relation").alias("type"))
    assert graph.owner_conflicts(owns).where("name = '7'").first()["owners"] >= 10_000
