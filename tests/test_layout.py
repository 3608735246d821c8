"""Layout beside attributes that have the names of its columns."""

import uuid

from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.operators import layout, tables


def test_index_keeps_attributes(spark):
    schema = f"layout_{uuid.uuid4().hex}"
    table = f"{schema}.places"
    rows = spark.range(50).select(
        "id", F.lit(77.0).alias("xmin"), F.lit("keep").alias("morton"),
        geo.point(F.col("id"), F.col("id") % 7).alias("geom"),
        geo.point(-F.col("id"), F.lit(1.0)).alias("label"))
    tables.replace_table(rows, table)
    assert tables.index_geometry(spark, table, "geom")
    assert not tables.index_geometry(spark, table, "geom")
    done = spark.table(table)
    kept = [(r["id"], r["xmin"], r["morton"]) for r in done.orderBy("id").collect()]
    assert kept == [(i, 77.0, "keep") for i in range(50)]
    assert layout.in_box(done, (10.0, 0.0, 12.0, 9.0), "geom_").count() == 3
    # Another column: the old bounds go, the attributes stay.
    assert tables.index_geometry(spark, table, "label")
    again = spark.table(table)
    assert set(again.columns) == set(rows.columns) | {f"label_{n}" for n in (*layout.BOX, "morton")}
    assert again.where("xmin = 77.0 and morton = 'keep'").count() == 50


def test_a_box_of_either_geometry_skips_files(spark, tmp_path):
    rows = spark.range(4000).select(
        "id", geo.point(F.col("id") % 64, (F.col("id") * 7) % 61).alias("a"),
        F.when(F.col("id") % 9 > 0, geo.point((F.col("id") * 31) % 59, (F.col("id") * 13) % 53)).alias("b"))
    laid_out, mark = layout.lay_out(rows, ["a", "b"])
    assert mark == "a=a_,b=b_:curve"
    laid_out.repartitionByRange(64, "curve").write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).groupBy(F.col("_metadata.file_name").alias("f")).agg(
        *[f(f"{p}_{n}").alias(f"{p}_{n}") for p in "ab" for f, n in zip((F.min, F.min, F.max, F.max), layout.BOX)])
    total = files.count()
    for prefix in ("a_", "b_"):
        assert layout.in_box(files, (10.0, 10.0, 18.0, 18.0), prefix).count() < total / 2


def test_several_columns_are_indexed_once_and_again(spark):
    schema = f"layout_{uuid.uuid4().hex}"
    table = f"{schema}.places"
    rows = spark.range(9).select("id", F.lit(1).alias("curve"), geo.point(F.col("id"), F.col("id")).alias("a"),
                                 geo.point(-F.col("id"), F.col("id")).alias("b"))
    tables.replace_table(rows, table)
    assert tables.index_geometry(spark, table, "a")
    assert tables.index_geometries(spark, table, ["a", "b"])
    assert not tables.index_geometries(spark, table, ["b", "a"])
    done = spark.table(table)
    assert set(done.columns) == {"id", "curve", "_curve", "a", "b"} | {f"{p}_{n}" for p in "ab" for n in layout.BOX}
    assert layout.in_box(done, (-3.0, 0.0, 0.0, 9.0), "b_").count() == 4
