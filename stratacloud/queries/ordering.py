"""Windows, allocations, orders and limits (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratacloud.fixtures import NODES_SQL, nodes, table
from stratacloud.functions.geometry import box_distance
from stratacloud.operators.allocation import allocate
from stratacloud.plans import render_plan, selection
from stratacloud.plans.expansion import nearest_pages
from stratacloud.queries import query
from stratacloud.queries.aggregates import RANKED_SQL
from stratacloud.queries.functions import _D3
from stratacloud.queries.planners import visible_points, visible_points_sql
from stratacloud.queries.trees import _KEYS, stream_keys

N = "WITH " + NODES_SQL
query("pln_1_visible_points", visible_points_sql())(visible_points)
_D2 = "sqrt(pow(greatest(min_x - 310, 310 - max_x, 0), 2) + pow(greatest(min_y - 640, 640 - max_y, 0), 2))"
_POS = ", k AS (SELECT *, row_number() OVER (ORDER BY depth, z, y, x) AS pos, CASE WHEN depth < 2 THEN key ELSE '2-' || (x >> (depth - 2)) || '-' || (y >> (depth - 2)) || '-' || (z >> (depth - 2)) END AS bucket FROM nodes)"


def positions(spark, d):
    return nodes(spark, d).withColumn("pos", F.row_number().over(Window.orderBy("depth", "z", "y", "x")))


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


@query("win_3_progressive_coverage", N + _POS + ", r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS round FROM k) SELECT key, CAST(row_number() OVER (ORDER BY round, bucket) - 1 AS BIGINT) AS place FROM r")
def win_3(spark, d):
    return render_plan.progressive_coverage(positions(spark, d).select("pos", "key")).select("key", big("place"))


@query("win_4_additive_progress", N + _POS + ", r AS (SELECT *, row_number() OVER (PARTITION BY depth, bucket ORDER BY pos) AS round FROM k) SELECT key, CAST(row_number() OVER (ORDER BY depth, round, bucket) - 1 AS BIGINT) AS place FROM r")
def win_4(spark, d):
    p = positions(spark, d).select("pos", "key")
    return render_plan.additive_progress(p.unionAll(p.filter("pos < 20"))).select("key", big("place"))


@query("win_5_distributed_picks", N + ", k AS (SELECT key, row_number() OVER (ORDER BY depth, z, y, x) - 1 AS i, count(*) OVER () AS n FROM nodes), p AS (SELECT unnest(range(25)) AS pick) SELECT CAST(pick AS BIGINT) AS pick, key FROM p JOIN k ON k.i = floor(pick * (k.n - 1) / CAST(24 AS DOUBLE) + 0.5)")
def win_5(spark, d):
    return render_plan.distributed_picks(positions(spark, d).select("pos", "key"), 25).select(big("pick"), "key")


def _fair_sql(entries: str, per_node: int, budget: int) -> str:
    """Fair shares by trying every level: the greatest that the budget holds, and one more for the first entries above it."""
    return f"""{entries}, u AS (SELECT *, CASE WHEN priority THEN {budget} ELSE greatest({budget} - coalesce(sum(cap) FILTER (WHERE priority) OVER (PARTITION BY request), 0), 0) END AS own FROM e),
 v AS (SELECT request, priority, own, h, sum(least(cap, h)) AS used FROM u, range({per_node} + 1) AS t(h) GROUP BY ALL), l AS (SELECT request, priority, max(h) AS h FROM v WHERE used <= own GROUP BY ALL),
 f AS (SELECT u.*, least(cap, h) AS filled, CASE WHEN cap > h THEN 1 ELSE 0 END AS o, own - sum(least(cap, h)) OVER (PARTITION BY request, priority) AS rest FROM u JOIN l USING (request, priority)),
 g AS (SELECT *, CAST(filled + CASE WHEN o = 1 AND sum(o) OVER (PARTITION BY request, priority ORDER BY pos) <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM f)"""


@query("win_6_fair_shares", _fair_sql(N + _POS + ", e AS (SELECT CAST(depth % 2 AS BIGINT) AS request, pos, least(point_count, 150) AS cap, x = 0 AS priority FROM k)", 150, 4_000) + " SELECT request, pos, allocated FROM g")
def win_6(spark, d):
    n = positions(spark, d).select((F.col("depth") % 2).cast("bigint").alias("request"), big("pos"), F.col("point_count").alias("points"), F.lit(None).cast("double").alias("weight"), (F.col("x") == 0).alias("priority"))
    return allocate(n, 4_000, 150, weighted=False)


_WEIGHTED_SQL = (
    "WITH RECURSIVE " + NODES_SQL + _POS + """, e AS (SELECT CAST(depth % 2 AS BIGINT) AS request, pos, least(point_count, 150) AS cap, CAST(x + 1 AS DOUBLE) AS w FROM k),
 r(request, turn, spare, wide) AS (SELECT request, 0, CAST(4000 AS HUGEINT), sum(w) FROM e GROUP BY request
  UNION ALL SELECT r.request, r.turn + 1, 4000 - coalesce(sum(cap) FILTER (WHERE cap <= spare * w / wide), 0), sum(w) FILTER (WHERE cap > spare * w / wide) FROM r JOIN e ON e.request = r.request WHERE turn < 40 GROUP BY r.request, r.turn, spare, wide HAVING sum(w) FILTER (WHERE cap > spare * w / wide) < wide),
 l AS (SELECT request, max_by(spare, turn) AS spare, max_by(wide, turn) AS wide FROM r GROUP BY request),
 q AS (SELECT e.*, spare * w / wide AS quota FROM e JOIN l USING (request)),
 f AS (SELECT *, cap <= quota AS full_, CASE WHEN cap <= quota THEN cap ELSE floor(quota) END AS filled FROM q),
 g AS (SELECT *, 4000 - sum(filled) OVER (PARTITION BY request) AS rest, row_number() OVER (PARTITION BY request ORDER BY full_, CASE WHEN full_ THEN 0 ELSE quota - floor(quota) END DESC, pos) AS nth FROM f)
 SELECT request, pos, CAST(filled + CASE WHEN NOT full_ AND nth <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM g"""
)


@query("win_7_weighted_shares", _WEIGHTED_SQL)
def win_7(spark, d):
    n = positions(spark, d).select((F.col("depth") % 2).cast("bigint").alias("request"), big("pos"), F.col("point_count").alias("points"), (F.col("x") + 1).cast("double").alias("weight"), F.lit(False).alias("priority"))
    return allocate(n, 4_000, 150, weighted=True)


@query("win_8_request_priorities", N + ", k AS (SELECT key, point_count AS w, row_number() OVER (ORDER BY depth, z, y, x) - 1 AS r, count(*) OVER () AS n, max(point_count) OVER () AS top FROM nodes) SELECT key, round(40 + CASE WHEN n > 1 THEN 0.9 * (n - 1 - r) / (n - 1) ELSE 0.9 END + 0.01 * (1 - w / CAST(top AS DOUBLE)), 9) AS priority FROM k")
def win_8(spark, d):
    return render_plan.request_priorities(positions(spark, d).withColumn("weight", F.col("point_count")), 40.0).select("key", F.round("priority", 9).alias("priority"))


@query("win_9_points_per_node", "SELECT event_id, CAST(least(5000, ceil(360000.0 / greatest(event_id % 300, 1))) AS BIGINT) AS capped, CAST(5000 AS BIGINT) AS free FROM events")
def win_9(spark, d):
    args = F.lit(5000), F.lit(360_000), F.col("event_id") % 300
    return table(spark, d, "events").select("event_id", render_plan.points_per_node(*args).cast("bigint").alias("capped"), render_plan.points_per_node(*args, headroom=True).cast("bigint").alias("free"))


@query("top_1_suggested_node", N + f" SELECT key FROM nodes WHERE depth = 2 ORDER BY {_D2}, depth DESC, point_count DESC, key LIMIT 1")
def top_1(spark, d):
    away = box_distance(F.lit(310.0), F.lit(640.0))
    return nodes(spark, d).filter("depth = 2").orderBy(away, F.col("depth").desc(), F.col("point_count").desc(), "key").limit(1).select("key")


@query("top_2_pages_for_target", N + f" SELECT key FROM nodes WHERE depth >= 2 ORDER BY {_D2}, depth, key LIMIT 2")
def top_2(spark, d):
    return nearest_pages(nodes(spark, d).filter("depth >= 2"), (310.0, 640.0), 2).select("key")


@query("top_3_nearest_order", N + f" SELECT key, row_number() OVER (ORDER BY {_D3}, depth DESC, point_count DESC, key) AS place FROM nodes")
def top_3(spark, d):
    n = nodes(spark, d).withColumn("distance", box_distance(F.lit(500.0), F.lit(500.0), F.lit(1800.0)))
    return n.select("key", F.row_number().over(Window.orderBy("distance", F.col("depth").desc(), F.col("point_count").desc(), "key")).cast("bigint").alias("place"))


@query("top_4_coverage_order", N + f" SELECT key, row_number() OVER (ORDER BY {_D3}, x, y, z, key) AS place FROM nodes")
def top_4(spark, d):
    n = nodes(spark, d).withColumn("distance", box_distance(F.lit(500.0), F.lit(500.0), F.lit(1800.0)))
    return n.select("key", F.row_number().over(Window.orderBy("distance", "x", "y", "z", "key")).cast("bigint").alias("place"))


@query("top_5_catalog_order", N + " SELECT key, row_number() OVER (ORDER BY depth, z, y, x) AS place FROM nodes")
def top_5(spark, d):
    return positions(spark, d).select("key", F.col("pos").cast("bigint").alias("place"))


@query("top_6_request_orders", N + ", k AS (SELECT *, row_number() OVER (ORDER BY depth, z, y, x) AS pos FROM nodes) SELECT key, row_number() OVER (ORDER BY data_length, pos) AS light, row_number() OVER (ORDER BY point_count DESC, pos) AS dense FROM k")
def top_6(spark, d):
    place = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("bigint")
    return positions(spark, d).select("key", place("data_length", "pos").alias("light"), place(F.col("point_count").desc(), "pos").alias("dense"))


@query("top_7_depth_orders", N + ", d AS (SELECT DISTINCT depth FROM nodes) SELECT depth, row_number() OVER (ORDER BY abs(depth - 1), -depth) AS nearest, row_number() OVER (ORDER BY CASE WHEN depth <= 1 THEN 0 ELSE 1 END, CASE WHEN depth <= 1 THEN -depth ELSE depth END) AS coverage FROM d")
def top_7(spark, d):
    dep, one = F.col("depth"), F.lit(1)
    place = lambda o: F.row_number().over(Window.orderBy(*o)).cast("bigint")
    return nodes(spark, d).select("depth").distinct().select("depth", place(selection.nearest_first(dep, one)).alias("nearest"), place(selection.down_then_up(dep, one)).alias("coverage"))


@query("top_8_prefix_limit", "WITH " + RANKED_SQL + " SELECT node_key, CAST(count(*) FILTER (WHERE prog_rank < 12) AS BIGINT) AS kept, round(least(1.0, CAST(12 AS DOUBLE) / count(*)), 6) AS density_scale FROM placed GROUP BY node_key")
def top_8(spark, d):
    from stratacloud.fixtures import points
    from stratacloud.operators.sampling import ranked

    r = ranked(points(spark, d))
    return r.groupBy("node_key").agg(F.count_if(F.col("prog_rank") < 12).alias("kept"), F.round(F.least(F.lit(1.0), F.lit(12.0) / F.count(F.lit(1))), 6).alias("density_scale"))


@query("top_9_allocated_points", _fair_sql(N + _POS + ", e AS (SELECT 0 AS request, pos, key, least(point_count, 40) AS cap, false AS priority FROM k)", 40, 3_000) + " SELECT key AS node_key, allocated AS n FROM g WHERE allocated > 0")
def top_9(spark, d):
    """Fair shares applied to the ranked points; nodes without a share give none."""
    from stratacloud.fixtures import points
    from stratacloud.operators.sampling import sample

    n = positions(spark, d).select(F.lit(0).cast("bigint").alias("request"), big("pos"), F.col("point_count").alias("points"), F.lit(None).cast("double").alias("weight"), F.lit(False).alias("priority"), "key")
    shares = allocate(n.drop("key"), 3_000, 40, weighted=False).join(n.select("pos", "key"), "pos").filter("allocated > 0")
    return sample(points(spark, d), shares.select("key", F.col("allocated").alias("budget"))).groupBy("node_key").agg(F.count(F.lit(1)).alias("n"))


@query("top_10_queue_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5 DESC, ts, event_id) AS place FROM events")
def top_10(spark, d):
    w = Window.partitionBy("user_id").orderBy((F.col("event_id") % 5).desc(), "ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("place"))


def _timed(keys):
    hit = F.col("pos") % 3 == 0
    return keys.select("pos", "key", F.when(hit, F.lit(0.0)).otherwise(F.col("value")).alias("ms"), hit.alias("cache_hit"))


@query("top_11_cache_hit_timing", f"WITH {_KEYS} SELECT pos, key, CAST(CASE WHEN pos % 3 = 0 THEN 0 ELSE value END AS DOUBLE) AS ms, pos % 3 = 0 AS cache_hit FROM keys")
def top_11(spark, d):
    return _timed(stream_keys(spark, d))
