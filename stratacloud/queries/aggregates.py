"""Aggregations, sampling and image metrics (AGG, SNK, IMG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratacloud.fixtures import NODES_SQL, POINTS_SQL, RECORD_BYTES, ROOT_SPACING, nodes, points, table
from stratacloud.functions.geometry import finite
from stratacloud.operators import images
from stratacloud.queries import query
from stratacloud.queries.functions import _D3, MORTON_SQL, r6
from stratacloud.queries.planners import CAMERA

P, N = "WITH " + POINTS_SQL, "WITH " + NODES_SQL


@query("src_15_inspection", P + f" SELECT CAST(count(*) AS BIGINT) AS point_count, {RECORD_BYTES} AS record_bytes, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(min(z), 6) AS min_z, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(max(z), 6) AS max_z, CAST({ROOT_SPACING} AS DOUBLE) AS spacing FROM points")
def src_15(spark, d):
    p = points(spark, d)
    ends = [r6(f(a)).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    return p.agg(F.count(F.lit(1)).alias("point_count"), F.lit(RECORD_BYTES).alias("record_bytes"), *ends, F.lit(ROOT_SPACING).alias("spacing"))


@query("src_16_hierarchy", N + " SELECT key, depth, x, y, z, point_count, data_offset, data_length FROM nodes")
def src_16(spark, d):
    return nodes(spark, d).select("key", "depth", "x", "y", "z", "point_count", "data_offset", "data_length").orderBy("depth", "z", "y", "x")


@query("agg_1_point_bounds", P + " SELECT node_key, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM points GROUP BY node_key")
def agg_1(spark, d):
    ok = lambda a: F.when(finite(F.col(a)), F.col(a))
    return points(spark, d).groupBy("node_key").agg(*[r6(f(ok(a))).alias(f"{n}_{a}") for a in "xz" for n, f in (("min", F.min), ("max", F.max))])


@query("agg_2_hierarchy_bounds", N + " SELECT min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM nodes WHERE depth = 0 OR NOT EXISTS (SELECT 1 FROM nodes WHERE depth = 0)")
def agg_2(spark, d):
    """The root's box, or else the union of all."""
    box = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]
    f = {"min": F.min, "max": F.max}
    return nodes(spark, d).agg(*[F.coalesce(F.max(F.when(F.col("depth") == 0, F.col(c))), f[c[:3]](c)).alias(c) for c in box])


@query("agg_3_depth_estimates", N + f""", e AS (SELECT *, {_D3} AS dist FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY dist, point_count DESC, key) AS k, count(*) OVER (PARTITION BY depth) AS n FROM e)
 SELECT depth, CAST(n AS BIGINT) AS n, key AS nearest, round((max_x - min_x) / greatest(dist, max_x - min_x) * 1080, 6) AS node_px, round({ROOT_SPACING} / (1 << depth) / greatest(dist, {ROOT_SPACING} / (1 << depth)) * 1080, 6) AS spacing_px FROM r WHERE k = 1""")
def agg_3(spark, d):
    from stratacloud.plans.selection import candidates, depth_estimates

    e = depth_estimates(candidates(nodes(spark, d), CAMERA), CAMERA)
    return e.select("depth", "n", "nearest", r6(F.col("node_px")).alias("node_px"), r6(F.col("spacing_px")).alias("spacing_px"))


@query("agg_4_usage", N + " SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(point_count) AS BIGINT) AS points, CAST(sum(data_length) AS BIGINT) AS bytes FROM nodes WHERE depth <= 2")
def agg_4(spark, d):
    return nodes(spark, d).filter("depth <= 2").agg(F.count(F.lit(1)).alias("nodes"), F.sum("point_count").alias("points"), F.sum("data_length").alias("bytes"))


@query("agg_5_source_nodes", N + " SELECT depth, CAST(sum(point_count) AS BIGINT) AS points, CAST(sum(data_length) AS BIGINT) AS bytes FROM nodes GROUP BY depth")
def agg_5(spark, d):
    return nodes(spark, d).groupBy("depth").agg(F.sum("point_count").alias("points"), F.sum("data_length").alias("bytes"))


@query("agg_6_merged_stats", "SELECT event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id END) AS BIGINT) AS hits, CAST(sum(CASE WHEN event_type = 'none' THEN 1 END) AS BIGINT) AS misses FROM events GROUP BY event_type")
def agg_6(spark, d):
    """Counters add up; one that no worker has stays null."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("hits"), F.sum(F.when(F.col("event_type") == "none", 1)).cast("bigint").alias("misses"))


@query("agg_7_timings", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, max(value) AS slowest, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS cache_hits, array_to_string(list_transform(list_sort(list(value), 'DESC')[1:5], lambda v: CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR)), ',') AS top_5 FROM events GROUP BY user_id")
def agg_7(spark, d):
    e = table(spark, d, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc())))
    few = F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "value")))
    text = F.array_join(F.transform(F.array_sort(few), lambda v: F.round(v["value"] * 100).cast("bigint").cast("string")), ",")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest"), F.count_if(F.col("event_type") == "view").alias("cache_hits"), text.alias("top_5"))


@query("agg_8_multi_node_totals", N + " SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(point_count) AS BIGINT) AS source_points, CAST(sum(least(point_count, 20)) AS BIGINT) AS sampled FROM nodes")
def agg_8(spark, d):
    return nodes(spark, d).agg(F.count(F.lit(1)).alias("nodes"), F.sum("point_count").alias("source_points"), F.sum(F.least("point_count", F.lit(20))).alias("sampled"))


@query("agg_9_weighted_coverage", N + " SELECT round(CAST(sum(point_count) FILTER (WHERE x % 3 <> 0) AS DOUBLE) / sum(point_count), 6) AS ratio FROM nodes")
def agg_9(spark, d):
    return nodes(spark, d).agg(r6(F.sum(F.when(F.col("x") % 3 != 0, F.col("point_count"))) / F.sum("point_count")).alias("ratio"))


@query("agg_11_initial_coverage", N + " SELECT round(avg(CASE WHEN x % 2 = 0 AND least(point_count, 15) >= least(point_count, 20) THEN 1.0 ELSE 0.0 END), 6) AS ratio, CAST(count(*) FILTER (WHERE NOT (x % 2 = 0 AND least(point_count, 15) >= least(point_count, 20))) AS BIGINT) AS missing FROM nodes")
def agg_11(spark, d):
    """Final nodes that an early sample of theirs serves: as dense as the final one would be."""
    n = nodes(spark, d)
    early = n.filter("x % 2 = 0").select("key", F.least("point_count", F.lit(15)).alias("sampled"))
    useful = F.coalesce(F.col("sampled") >= F.least("point_count", F.lit(20)), F.lit(False))
    return n.join(early, "key", "left").agg(r6(F.avg(F.when(useful, 1.0).otherwise(0.0))).alias("ratio"), F.count_if(~useful).alias("missing"))


@query("agg_12_frame_times", "SELECT event_type, round(avg(value), 6) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS slowest, round(1000 / avg(value), 6) AS fps, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS over_50, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS over_100 FROM events GROUP BY event_type")
def agg_12(spark, d):
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), rank(0.5).alias("median"), rank(0.95).alias("p95"), F.max("value").alias("slowest"), r6(1000 / F.avg("value")).alias("fps"), F.count_if(F.col("value") > 50).alias("over_50"), F.count_if(F.col("value") > 100).alias("over_100"))


@query("agg_13_robust_sigma", "WITH s AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY ALL), g AS (SELECT event_type, median(m) AS centre FROM s GROUP BY event_type) SELECT event_type, round(any_value(centre), 6) AS centre, round(1.4826 * median(abs(m - centre)), 6) AS sigma FROM s JOIN g USING (event_type) GROUP BY event_type")
def agg_13(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("m"))
    g = s.groupBy("event_type").agg(F.median("m").alias("centre"))
    return s.join(g, "event_type").groupBy("event_type").agg(r6(F.first("centre")).alias("centre"), r6(F.median(F.abs(F.col("m") - F.col("centre"))) * 1.4826).alias("sigma"))


RANKED_SQL = MORTON_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY morton, point_id) - 1 AS r, count(*) OVER (PARTITION BY node_key) AS n FROM m),
 bits AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE CAST(length(ltrim(bin(n - 1), '0')) AS BIGINT) END AS b FROM rk),
 ranked AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE CAST(list_sum(list_transform(range(b), lambda i: ((xor(r, 1::BIGINT << (b - 1)) >> i) & 1) << (b - 1 - i))) AS BIGINT) END AS prog_key FROM bits),
 placed AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY prog_key) - 1 AS prog_rank FROM ranked)"""


@query("win_1_progressive_order", "WITH " + RANKED_SQL + " SELECT node_key, point_id, CAST(prog_key AS BIGINT) AS prog_key, CAST(prog_rank AS BIGINT) AS prog_rank FROM placed")
def win_1(spark, d):
    from stratacloud.operators.sampling import ranked

    return ranked(points(spark, d)).select("node_key", "point_id", "prog_key", F.col("prog_rank").cast("bigint").alias("prog_rank"))


@query("src_20_column_projection", P + " SELECT point_id, x, y, z, red, green, blue, classification, intensity FROM points WHERE node_key = '2-1-2-3'")
def src_20(spark, d):
    return points(spark, d).filter("node_key = '2-1-2-3'").select("point_id", "x", "y", "z", F.col("red").cast("bigint").alias("red"), F.col("green").cast("bigint").alias("green"), F.col("blue").cast("bigint").alias("blue"), "classification", "intensity")


@query("src_21_node_sample", "WITH " + RANKED_SQL + " SELECT node_key, point_id FROM placed WHERE prog_rank < 8")
def src_21(spark, d):
    from stratacloud.operators.sampling import prefix

    return prefix(points(spark, d), 8).select("node_key", "point_id")


@query("src_22_denser_answers", "WITH " + RANKED_SQL + " SELECT node_key, point_id FROM placed WHERE prog_rank < 5")
def src_22(spark, d):
    """A sample of 16 in hand answers one of 5: both are prefixes of one order."""
    from stratacloud.operators.sampling import prefix

    return prefix(points(spark, d), 16).filter("prog_rank < 5").select("node_key", "point_id")


_BUDGETS = ", bud AS (SELECT key, CAST(least(floor(2000 / count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY depth, z, y, x) <= 2000 % count(*) OVER () THEN 1 ELSE 0 END, 6, point_count) AS BIGINT) AS budget FROM nodes)"


@query("src_23_shared_budget", N + _BUDGETS + " SELECT key, budget FROM bud")
def src_23(spark, d):
    from stratacloud.operators.sampling import node_budgets

    return node_budgets(nodes(spark, d), 2000, 6)


@query("src_24_first_node", "WITH " + RANKED_SQL + " SELECT point_id FROM placed WHERE node_key = '0-0-0-0' AND prog_rank < 5000")
def src_24(spark, d):
    from stratacloud.api import PointCloud

    return PointCloud.load(spark, d).node_sample("0-0-0-0").select("point_id")


@query("snk_1_geometry_batches", P + " SELECT node_key, CAST(count(*) * 3 AS BIGINT) AS positions, CAST(count(*) * 4 AS BIGINT) AS colors FROM points GROUP BY node_key")
def snk_1(spark, d):
    """Nodes packed for a batch sink: flat positions and colours, in the order of points."""
    from stratacloud.operators.sampling import pack_batches

    b = pack_batches(points(spark, d))
    return b.select("node_key", F.size("positions").cast("bigint").alias("positions"), F.size("colors").cast("bigint").alias("colors"))


def _row_output(p):
    lines = p.select(F.to_json(F.struct("point_id", "node_key")).alias("line"))
    return lines.select(F.from_json("line", "point_id bigint, node_key string").alias("p")).select("p.*")


@query("snk_2_row_output", P + " SELECT point_id, node_key FROM points")
def snk_2(spark, d):
    """Points as rows, one by one, for sinks that take objects: JSON lines and back."""
    return _row_output(points(spark, d))


@query("snk_3_box_edges", N + " SELECT key, CAST(count(*) AS BIGINT) AS edges, round(sum(len), 6) AS total FROM (SELECT key, unnest([max_x - min_x, max_y - min_y, max_z - min_z, max_x - min_x, max_y - min_y, max_z - min_z, max_x - min_x, max_y - min_y, max_z - min_z, max_x - min_x, max_y - min_y, max_z - min_z]) AS len FROM nodes) GROUP BY key")
def snk_3(spark, d):
    """The twelve edges of each box as pairs of corners."""
    e = images.box_edges(nodes(spark, d))
    sq = lambda a: (F.col(f"to_{a}") - F.col(f"from_{a}")) * (F.col(f"to_{a}") - F.col(f"from_{a}"))
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("edges"), r6(F.sum(F.sqrt(sq("x") + sq("y") + sq("z")))).alias("total"))


@query("snk_4_chunk_merge", N + ", b AS (SELECT *, CASE WHEN x % 5 = 4 THEN NULL ELSE min_x END AS bx, CASE WHEN z % 3 = 0 THEN NULL ELSE y % 2 = 0 END AS clear FROM nodes) SELECT depth, CAST(sum(point_count) AS BIGINT) AS points, CASE WHEN bool_and(bx IS NOT NULL) THEN min(bx) END AS min_x, CASE WHEN bool_or(coalesce(clear, false)) THEN true WHEN bool_and(clear IS NOT NULL) THEN false END AS translucent FROM b GROUP BY depth")
def snk_4(spark, d):
    """Bounds are unknown if any batch's are; translucent if any is, opaque only if all say so."""
    b = nodes(spark, d).withColumn("bx", F.when(F.col("x") % 5 != 4, F.col("min_x"))).withColumn("clear", F.when(F.col("z") % 3 != 0, F.col("y") % 2 == 0))
    known = F.bool_and(F.col("bx").isNotNull())
    return b.groupBy("depth").agg(F.sum("point_count").alias("points"), F.when(known, F.min("bx")).alias("min_x"), F.when(F.bool_or(F.coalesce("clear", F.lit(False))), True).when(F.bool_and(F.col("clear").isNotNull()), False).alias("translucent"))


@query("snk_5_chunk_keys", N + " SELECT depth, string_agg(key || ':' || point_count, ',' ORDER BY z, y, x) AS chunk FROM nodes WHERE depth < 3 GROUP BY depth")
def snk_5(spark, d):
    part = F.struct("z", "y", "x", F.concat_ws(":", "key", F.col("point_count").cast("string")).alias("k"))
    return nodes(spark, d).filter("depth < 3").groupBy("depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda r: r["k"]), ",").alias("chunk"))


@query("snk_7_splat_size", N + f" SELECT key, round(least(5.0, greatest(1.75, {ROOT_SPACING} / (1 << depth) * 935.3074360871938 / greatest({_D3}, 1) * 0.9 * 1.25)), 6) AS pixels FROM nodes")
def snk_7(spark, d):
    from stratacloud.functions.geometry import box_distance

    s = ROOT_SPACING / F.pow(F.lit(2.0), F.col("depth"))
    px = images.splat_pixels(s, box_distance(*[F.lit(v) for v in CAMERA.eye]), scale=935.3074360871938, factor=0.9, coverage=1.25, low=1.75, high=5.0)
    return nodes(spark, d).select("key", r6(px).alias("pixels"))


#: Two images of 64 x 36 pixels out of points: what the cloud covers, and the same with other points.
_PIX = """, img AS (SELECT CAST(floor(x / 1000 * 63.999) AS BIGINT) AS px, CAST(floor(y / 1000 * 35.999) AS BIGINT) AS py, point_id FROM points),
 grid AS (SELECT gx AS px, gy AS py FROM range(64) a(gx), range(36) b(gy)),
 ma AS (SELECT g.px, g.py, bool_or(coalesce(i.point_id % 3 <> 0, false)) AS a, bool_or(coalesce(i.point_id % 5 <> 0, false)) AS b FROM grid g LEFT JOIN img i USING (px, py) GROUP BY ALL)"""


def _masks(spark, d):
    return images.masks(points(spark, d), 64, 36, {"a": F.col("point_id") % 3 != 0, "b": F.col("point_id") % 5 != 0})


@query("img_1_difference_mask", P + ", pix AS (SELECT point_id, CAST(red AS BIGINT) AS r, green AS g, blue AS b FROM points WHERE red IS NOT NULL) SELECT point_id, greatest(abs(r - 20), abs(g - 30), abs(b - 40)) >= 12 AS differs FROM pix")
def img_1(spark, d):
    p = points(spark, d).filter("red is not null")
    return p.select("point_id", images.differs([F.col("red"), F.col("green"), F.col("blue")], [F.lit(20), F.lit(30), F.lit(40)], 12).alias("differs"))


def _img_2_mask_stats(mask):
    s = images.mask_stats(mask, "a", 64, 36)
    return s.select("pixels", r6(F.col("coverage")).alias("coverage"), r6(F.col("occupied")).alias("occupied"), "isolated", "perimeter")


_IMG_2 = """, f AS (SELECT * FROM ma WHERE a), nb AS (SELECT f.px, f.py, count(g.px) FILTER (WHERE abs(g.px - f.px) + abs(g.py - f.py) = 1) AS sides, count(g.px) AS around FROM f LEFT JOIN f g ON abs(g.px - f.px) <= 1 AND abs(g.py - f.py) <= 1 AND (g.px <> f.px OR g.py <> f.py) GROUP BY ALL)
 SELECT CAST(count(*) AS BIGINT) AS pixels, round(count(*) / CAST(64 * 36 AS DOUBLE), 6) AS coverage, round(count(DISTINCT (px // 2) * 100 + py // 2) / CAST(32 * 18 AS DOUBLE), 6) AS occupied, CAST(count(*) FILTER (WHERE around = 0) AS BIGINT) AS isolated, CAST(sum(4 - sides) AS BIGINT) AS perimeter FROM nb"""


@query("img_2_mask_stats", P + _PIX + _IMG_2)
def img_2(spark, d):
    return _img_2_mask_stats(_masks(spark, d))


def _img_3_closed_mask(mask):
    return images.close_square(mask.select("px", "py", F.col("a").alias("v")), 1).filter("v").select("px", "py")


_IMG_3 = """, dl AS (SELECT m.px, m.py, (SELECT bool_or(n.a) FROM ma n WHERE abs(n.px - m.px) <= 1 AND abs(n.py - m.py) <= 1) AS v FROM ma m),
 er AS (SELECT m.px, m.py, (SELECT bool_and(n.v) FROM dl n WHERE abs(n.px - m.px) <= 1 AND abs(n.py - m.py) <= 1) AS v FROM dl m) SELECT px, py FROM er WHERE v"""


@query("img_3_closed_mask", P + _PIX + _IMG_3)
def img_3(spark, d):
    return _img_3_closed_mask(_masks(spark, d))


def _img_4_mask_support(mask):
    s = images.support(mask, "a", "b")
    return s.select(r6(F.col("retained")).alias("retained"), r6(F.col("unsupported")).alias("unsupported"))


_IMG_4 = " SELECT round(CAST(count(*) FILTER (WHERE a AND b) AS DOUBLE) / count(*) FILTER (WHERE a), 6) AS retained, round(CAST(count(*) FILTER (WHERE b AND NOT a) AS DOUBLE) / count(*) FILTER (WHERE b), 6) AS unsupported FROM ma"


@query("img_4_mask_support", P + _PIX + _IMG_4)
def img_4(spark, d):
    return _img_4_mask_support(_masks(spark, d))


@query("img_5_frame_digest", N + " SELECT sha256(string_agg(key || ':' || point_count, '|' ORDER BY depth, z, y, x)) AS digest FROM nodes")
def img_5(spark, d):
    part = F.struct("depth", "z", "y", "x", F.concat_ws(":", "key", F.col("point_count").cast("string")).alias("k"))
    return nodes(spark, d).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda r: r["k"]), "|"), 256).alias("digest"))


@query("img_6_failure_classes", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'network' WHEN event_type = 'error' THEN 'environment' WHEN value > 300 THEN 'timeout' ELSE 'pass' END AS outcome FROM events")
def img_6(spark, d):
    from stratacloud.functions.requests import step_outcome

    e = table(spark, d, "events")
    return e.select("event_id", step_outcome(F.col("event_type") == "error", F.col("value") > 100, F.col("value") > 300).alias("outcome"))


@query("img_7_pose_delta", "WITH p AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, round(greatest(abs(value - before), abs(value * 2 - before * 2), abs(value - before) / 2), 6) AS delta FROM p WHERE before IS NOT NULL")
def img_7(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pose = lambda v: F.array(v, v * 2, v / 2)
    e = table(spark, d, "events").withColumn("before", F.lag("value").over(w)).filter("before is not null")
    return e.select("event_id", r6(images.largest_delta(pose(F.col("value")), pose(F.col("before")))).alias("delta"))
