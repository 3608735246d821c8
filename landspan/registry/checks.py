"""Queries over checks, ids, defaults and published tables."""

from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.operators import checks, columns, layout, tables
from landspan.plans import derived
from landspan.plans.derived import table
from landspan.registry.common import published, scratch_schema

ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def b_gid(spark, folder):
    items = table(spark, folder, "lineitem").select(ITEM_ORDER)
    return columns.add_feature_id(items, "gid", ITEM_ORDER)


def b_gid_file_order(spark, folder):
    rows = columns.add_feature_id(table(spark, folder, "lineitem").select("l_quantity"))
    return rows.agg(
        F.count("*").alias("rows"), F.min("gid").alias("lowest"), F.max("gid").alias("highest"),
        F.count_distinct("gid").alias("ids"),
    )


def b_default(spark, folder):
    name = f"{scratch_schema(spark, 'default')}.suppliers"
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    tables.replace_table(suppliers, name)
    columns.set_default(spark, name, "s_name", "'unnamed'")
    suppliers.select((F.col("s_suppkey") + 1_000_000).alias("k")).createOrReplaceTempView("later")
    spark.sql(f"INSERT INTO {tables.sql_name(name)} (s_suppkey) SELECT k FROM later")
    return published(spark, name)


def c_not_null(spark, folder):
    orders = table(spark, folder, "orders")
    holed = orders.withColumns({
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW")),
        "o_custkey": F.nullif(F.col("o_custkey") % 10, F.lit(3)),
    })
    return checks.null_counts(holed, holed.columns)


def c_primary_key(spark, folder):
    orders = table(spark, folder, "orders")
    half = orders.withColumn("key", F.when(F.col("o_orderkey") % 100 != 1, F.expr("o_orderkey DIV 2")))
    return checks.key_violations(half, ["key"])


def c_primary_key_composite(spark, folder):
    return checks.key_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def d_replace(spark, folder):
    name = f"{scratch_schema(spark, 'replace')}.orders"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    first = tables.replace_table(orders, name)
    # The second version reads the table it replaces.
    return tables.replace_table(first.where("o_totalprice > 100000"), name)


def d_index_geometry(spark, folder):
    """Index a geometry column twice, the second time finds it done; all rows, and whether they meet a box."""
    name = f"{scratch_schema(spark, 'index')}.parts"
    tables.replace_table(derived.part_rectangles(table(spark, folder, "part")), name)
    done = [tables.index_geometry(spark, name, "geom") for _ in range(2)]
    rows = published(spark, name)
    found = layout.in_box(rows, (0.0, 0.0, 5_000.0, 5_000.0)).select("p_partkey", F.lit(True).alias("meets"))
    return rows.join(found, "p_partkey", "left").select(
        "p_partkey", *layout.BOX, F.coalesce("meets", F.lit(False)).alias("meets"),
        F.lit(",".join(map(str, done))).alias("built"))


def d_index_geometries(spark, folder):
    """Two geometry columns under one layout: all rows, and whether they meet a box of either."""
    name = f"{scratch_schema(spark, 'index')}.labelled"
    k = F.col("p_partkey")
    parts = derived.part_rectangles(table(spark, folder, "part")).select(
        "p_partkey", "geom", F.when(k % 10 > 0, geo.point((k * 7919 % 10007).cast("double"), -(k % 97))).alias("label"))
    tables.replace_table(parts, name)
    done = [tables.index_geometries(spark, name, ["geom", "label"]) for _ in range(2)]
    rows = published(spark, name)
    near = layout.in_box(rows, (0.0, 0.0, 5_000.0, 5_000.0), "geom_").select("p_partkey", F.lit(True).alias("in_geom"))
    far = layout.in_box(rows, (0.0, -50.0, 3_000.0, -10.0), "label_").select("p_partkey", F.lit(True).alias("in_label"))
    return rows.join(near, "p_partkey", "left").join(far, "p_partkey", "left").select(
        "p_partkey", "geom_xmin", "geom_ymax", "label_xmin", "label_ymax",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_geom", "in_label")],
        F.lit(",".join(map(str, done))).alias("built"))


QUERIES = {f.__name__: f for f in (
    b_gid, b_gid_file_order, b_default, c_not_null, c_primary_key, c_primary_key_composite,
    d_replace, d_index_geometry, d_index_geometries,
)}

ORACLES = {
    "b_gid": f"""SELECT row_number() OVER (ORDER BY {', '.join(ITEM_ORDER)}) AS gid,
        {', '.join(ITEM_ORDER)} FROM lineitem""",
    "b_gid_file_order": """SELECT count(*) AS rows, 1::BIGINT AS lowest, count(*) AS highest,
        count(*) AS ids FROM lineitem""",
    "b_default": """SELECT s_suppkey, s_name FROM supplier
        UNION ALL SELECT s_suppkey + 1000000, 'unnamed' FROM supplier""",
    "c_not_null": """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice',
            'o_orderdate', 'o_orderpriority']) AS column,
        unnest([0, count(*) FILTER (o_custkey % 10 = 3), 0, 0, 0,
            count(*) FILTER (o_orderpriority = '5-LOW')]) AS nulls FROM orders""",
    "c_primary_key": """SELECT CASE WHEN o_orderkey % 100 <> 1 THEN o_orderkey // 2 END AS key,
        count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1 OR key IS NULL""",
    "c_primary_key_composite": """SELECT l_orderkey, l_linenumber, count(*) AS copies
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "d_replace": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "d_index_geometries": """WITH rects AS (SELECT p_partkey, (p_partkey % 1000) * 100.0::DOUBLE AS x,
            (p_partkey // 1000) * 100.0::DOUBLE AS y, p_size AS w, p_partkey % 7 + 1 AS h,
            CASE WHEN p_partkey % 10 > 0 THEN (p_partkey * 7919 % 10007)::DOUBLE END AS lx,
            CASE WHEN p_partkey % 10 > 0 THEN -(p_partkey % 97)::DOUBLE END AS ly FROM part)
        SELECT p_partkey, x AS geom_xmin, y + h AS geom_ymax, lx AS label_xmin, ly AS label_ymax,
            x <= 5000 AND y <= 5000 AS in_geom, coalesce(lx BETWEEN 0 AND 3000 AND ly BETWEEN -50 AND -10, false) AS in_label,
            'True,False' AS built FROM rects""",
    "d_index_geometry": """WITH rects AS (SELECT p_partkey, (p_partkey % 1000) * 100.0::DOUBLE AS xmin,
            (p_partkey // 1000) * 100.0::DOUBLE AS ymin, p_size AS w, p_partkey % 7 + 1 AS h FROM part)
        SELECT p_partkey, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax,
            xmin <= 5000 AND ymin <= 5000 AND xmin + w >= 0 AND ymin + h >= 0 AS meets, 'True,False' AS built
        FROM rects""",
}
