"""A deterministic point cloud out of the order tables: points and the catalog of their additive octree.

Every point belongs to one node; children add points and never replace those of their ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacloud.functions.geometry import cell_index
from stratacloud.functions.keys import node_bounds, node_key

CUBE = (0.0, 0.0, 0.0, 1000.0, 1000.0, 1000.0)
ROOT_SPACING = 1000.0 / 128
RECORD_BYTES = 36
EXTENT = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, depth, nx, ny, nz, node_key, classification, intensity, red, green, blue."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("day"))
    box = o.agg(*[f(c).alias(f"{n}_{c}") for c in ("o_totalprice", "day", "o_custkey") for n, f in (("min", F.min), ("max", F.max))])
    # One row of limits; broadcast by construction.
    o = o.crossJoin(F.broadcast(box))
    axis = lambda c: EXTENT * (F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}"))
    pid = F.col("point_id")
    p = o.select(F.col("o_orderkey").alias("point_id"), axis("o_totalprice").alias("x"), axis("day").alias("y"), axis("o_custkey").alias("z"), F.col("o_orderpriority").alias("priority"), F.floor("o_totalprice").alias("price"))
    depth = F.when(pid % 512 == 0, 0).when(pid % 64 == 0, 1).when(pid % 8 == 0, 2).otherwise(3)
    p = p.withColumn("depth", depth)
    for n, c in (("nx", "x"), ("ny", "y"), ("nz", "z")):
        p = p.withColumn(n, cell_index(F.col(c), F.col("depth"), EXTENT))
    even = pid % 2 == 0
    return p.select(
        "point_id", "x", "y", "z", "depth", "nx", "ny", "nz",
        node_key("depth", "nx", "ny", "nz").alias("node_key"),
        F.when(pid % 7 == 0, None).when(pid % 11 == 0, 12).otherwise(F.substring("priority", 1, 1).cast("int") + 1).alias("classification"),
        F.when(pid % 5 == 0, None).otherwise(F.col("price") % 65536).cast("long").alias("intensity"),
        F.when(even, pid % 256).cast("int").alias("red"), F.when(even, (pid * 7) % 256).cast("int").alias("green"), F.when(even, (pid * 13) % 256).cast("int").alias("blue"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, one row per node with points: a few hundred rows whatever the number of points."""
    cell = ("depth", "nx", "ny", "nz")
    # The cells come as aggregates: Spark would carry what is asked of a grouping column down to every point, once per use of the catalog.
    g = points(spark, sf_dir).groupBy(*cell).agg(F.count(F.lit(1)).alias("point_count"), *[F.max(c).alias(f"the_{c}") for c in cell]).select("point_count", *[F.col(f"the_{c}").alias(c) for c in cell])
    g = g.withColumn("node_key", node_key(*cell))
    size = F.col("point_count") * RECORD_BYTES
    gap = 40 * ((F.col("nx") + F.col("ny") + F.col("nz")) % 3)
    ordered = Window.orderBy("depth", "nz", "ny", "nx").rowsBetween(Window.unboundedPreceding, -1)
    box = node_bounds(F.col("depth"), F.col("nx"), F.col("ny"), F.col("nz"), CUBE)
    n = g.select(F.col("node_key").alias("key"), "depth", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), *[c.alias(a) for a, c in box.items()], "point_count", size.alias("data_length"), F.coalesce(F.sum(size + gap).over(ordered), F.lit(0)).alias("data_offset"))
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    return n.withColumn("density", F.col("point_count") / F.greatest(volume, F.lit(2.0**-52)))


#: The same tables as common table expressions for the checking engine.
POINTS_SQL = """
lim AS (SELECT min(o_totalprice) AS x0, max(o_totalprice) AS x1, min(d) AS y0, max(d) AS y1, min(o_custkey) AS z0, max(o_custkey) AS z1
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)),
p0 AS (SELECT o_orderkey AS point_id, 1000.0 * (o_totalprice - x0) / (x1 - x0) AS x,
  CAST(1000.0 AS DOUBLE) * (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) - y0) / (y1 - y0) AS y,
  CAST(1000.0 AS DOUBLE) * (o_custkey - z0) / (z1 - z0) AS z, o_orderpriority AS priority, CAST(floor(o_totalprice) AS BIGINT) AS price,
  CASE WHEN o_orderkey % 512 = 0 THEN 0 WHEN o_orderkey % 64 = 0 THEN 1 WHEN o_orderkey % 8 = 0 THEN 2 ELSE 3 END AS depth FROM orders, lim),
p1 AS (SELECT *, CAST(least((1 << depth) - 1, floor(x / 1000 * (1 << depth))) AS BIGINT) AS nx,
  CAST(least((1 << depth) - 1, floor(y / 1000 * (1 << depth))) AS BIGINT) AS ny, CAST(least((1 << depth) - 1, floor(z / 1000 * (1 << depth))) AS BIGINT) AS nz FROM p0),
points AS (SELECT point_id, x, y, z, depth, nx, ny, nz, depth || '-' || nx || '-' || ny || '-' || nz AS node_key,
  CASE WHEN point_id % 7 = 0 THEN NULL WHEN point_id % 11 = 0 THEN 12 ELSE CAST(substr(priority, 1, 1) AS INTEGER) + 1 END AS classification,
  CASE WHEN point_id % 5 = 0 THEN NULL ELSE price % 65536 END AS intensity,
  CASE WHEN point_id % 2 = 0 THEN point_id % 256 END AS red, CASE WHEN point_id % 2 = 0 THEN (point_id * 7) % 256 END AS green,
  CASE WHEN point_id % 2 = 0 THEN (point_id * 13) % 256 END AS blue FROM p1)
"""
NODES_SQL = POINTS_SQL + """,
n0 AS (SELECT node_key AS key, depth, nx AS x, ny AS y, nz AS z, count(*) AS point_count FROM points GROUP BY ALL),
n1 AS (SELECT *, 1000.0 / (1 << depth) AS side, point_count * 36 AS data_length,
  CAST(coalesce(sum(point_count * 36 + 40 * ((x + y + z) % 3)) OVER (ORDER BY depth, z, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM n0),
nodes AS (SELECT key, depth, x, y, z, CAST(x * side AS DOUBLE) AS min_x, CAST(y * side AS DOUBLE) AS min_y, CAST(z * side AS DOUBLE) AS min_z,
  CAST((x + 1) * side AS DOUBLE) AS max_x, CAST((y + 1) * side AS DOUBLE) AS max_y, CAST((z + 1) * side AS DOUBLE) AS max_z,
  point_count, data_length, data_offset, point_count / CAST(side * side * side AS DOUBLE) AS density FROM n1)
"""
