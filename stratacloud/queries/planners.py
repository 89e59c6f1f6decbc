"""Selection planners, traversal, render plans and settings (PLN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.api import PointCloud
from stratacloud.fixtures import NODES_SQL, nodes, table
from stratacloud.plans import mixed_depth, render_plan, selection, settings
from stratacloud.plans.selection import Camera
from stratacloud.queries import query
from stratacloud.queries.functions import _D3, ROOT_SPACING

N, NR = "WITH " + NODES_SQL, "WITH RECURSIVE " + NODES_SQL
CAMERA = Camera(target=(500.0, 500.0, 1800.0), eye=(500.0, 500.0, 1800.0), node_pixels=330.0, spacing_pixels=3.0, max_nodes=96, max_points=20_000)
#: Budgets that bind at any scale: sums are cut, single nodes too.
TIGHT = Camera(**(CAMERA.__dict__ | {"max_nodes": 40, "max_points": 1_500, "max_node_points": 300}))

_EST = f", c AS (SELECT *, {_D3} AS dist FROM nodes), e AS (SELECT depth, min_by(struct_pack(npx := (max_x - min_x) / greatest(dist, max_x - min_x) * 1080, spx := {ROOT_SPACING} / (1 << depth) / greatest(dist, {ROOT_SPACING} / (1 << depth)) * 1080), struct_pack(a := dist, b := -point_count, c := key)) AS near FROM c GROUP BY depth), t AS (SELECT coalesce(min(depth) FILTER (WHERE near.npx <= 330 AND near.spx <= 3), max(depth)) AS target FROM e)"
_COMPLETE = _EST + """, d AS (SELECT depth, count(*) AS n, sum(point_count) AS p, lag(count(*)) OVER (ORDER BY depth) AS shallower FROM c GROUP BY depth),
 best AS (SELECT depth FROM d, t WHERE NOT coalesce(shallower > 0 AND n < shallower, false) AND n <= 96 AND p <= 20000 ORDER BY CASE WHEN depth <= target THEN 0 ELSE 1 END, CASE WHEN depth <= target THEN -depth ELSE depth END LIMIT 1),
 sel AS (SELECT c.* FROM c JOIN best USING (depth))"""
_CLOSED = _COMPLETE + ", closed AS (SELECT DISTINCT n.* FROM nodes n JOIN sel s ON s.depth >= n.depth AND s.x >> (s.depth - n.depth) = n.x AND s.y >> (s.depth - n.depth) = n.y AND s.z >> (s.depth - n.depth) = n.z)"


def visible_points_sql() -> str:
    from stratacloud.queries.aggregates import RANKED_SQL
    from stratacloud.queries.functions import _ATTR, _PALETTE

    nodes_part = NODES_SQL[NODES_SQL.index("n0 AS") :]
    return "WITH " + RANKED_SQL + ", " + nodes_part + _CLOSED + f""", bud AS (SELECT key, CAST(least(floor(5000 / count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY depth, z, y, x) <= 5000 % count(*) OVER () THEN 1 ELSE 0 END, 200, point_count) AS BIGINT) AS budget FROM closed)
 SELECT point_id, node_key, round(x, 6) AS lon, round(y, 6) AS lat, round(z, 6) AS height, CAST({_ATTR} AS BIGINT) AS rgb FROM placed JOIN bud ON key = node_key LEFT JOIN {_PALETTE} ON cls = classification WHERE prog_rank < budget"""


def visible_points(spark, d):
    """Which points does this viewer get: select a depth, close it, share a point budget, sample, colour."""
    out = PointCloud.load(spark, d).render(CAMERA, total=5_000, per_node=200)
    return out.select("point_id", "node_key", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "height")], "rgb")


@query("pln_2_target_depth", N + _EST + " SELECT target FROM t")
def pln_2(spark, d):
    found = selection.candidates(nodes(spark, d), CAMERA)
    return selection.target_depth(selection.depth_estimates(found, CAMERA), CAMERA)


@query("pln_1_closed_selection", N + _CLOSED + " SELECT key, depth, point_count FROM closed")
def pln_1(spark, d):
    return PointCloud.load(spark, d).select(CAMERA).select("key", "depth", "point_count")


_FOLD = """, o AS (SELECT depth, key, point_count, row_number() OVER (PARTITION BY depth ORDER BY dist, depth DESC, point_count DESC, key) AS i FROM c),
 g(depth, i, taken, points, skipped, keys) AS (SELECT depth, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT depth FROM o)
 UNION ALL SELECT g.depth, o.i, CASE WHEN g.taken < 40 AND o.point_count <= 300 AND g.points + o.point_count <= 1500 THEN g.taken + 1 ELSE g.taken END, CASE WHEN g.taken < 40 AND o.point_count <= 300 AND g.points + o.point_count <= 1500 THEN g.points + o.point_count ELSE g.points END,
 CASE WHEN g.taken < 40 AND NOT (o.point_count <= 300 AND g.points + o.point_count <= 1500) THEN g.skipped + 1 ELSE g.skipped END, CASE WHEN g.taken < 40 AND o.point_count <= 300 AND g.points + o.point_count <= 1500 THEN list_append(g.keys, o.key) ELSE g.keys END
 FROM g JOIN o ON o.depth = g.depth AND o.i = g.i + 1)"""


@query("pln_3_greedy", NR + _EST + _FOLD + " SELECT g.depth, array_to_string(g.keys, ',') AS chosen, CAST(g.skipped AS BIGINT) AS skipped FROM g JOIN (SELECT depth, max(i) AS i FROM o GROUP BY depth) m ON m.depth = g.depth AND m.i = g.i")
def pln_3(spark, d):
    found = selection.candidates(nodes(spark, d), TIGHT)
    picks = selection.greedy(found, TIGHT, [F.col("distance"), -F.col("depth"), -F.col("point_count"), F.col("key")], "depth")
    return picks.select("depth", F.array_join("chosen", ",").alias("chosen"), "skipped")


@query("pln_3_nearest", NR + _EST + _FOLD + ", l AS (SELECT g.depth, g.keys FROM g JOIN (SELECT depth, max(i) AS i FROM o GROUP BY depth) m ON m.depth = g.depth AND m.i = g.i WHERE len(g.keys) > 0), b AS (SELECT keys FROM l, t ORDER BY abs(depth - target), -depth LIMIT 1) SELECT CAST(p - 1 AS BIGINT) AS pos, keys[p] AS key FROM (SELECT keys, unnest(range(1, len(keys) + 1)) AS p FROM b)")
def pln_3_nearest(spark, d):
    found = selection.candidates(nodes(spark, d), TIGHT)
    target = selection.target_depth(selection.depth_estimates(found, TIGHT), TIGHT)
    return selection.select_nearest(found, TIGHT, target).select(F.col("pos").cast("bigint").alias("pos"), "key")


@query("pln_4_complete_depth", N + _COMPLETE + " SELECT CAST(row_number() OVER (ORDER BY dist, x, y, z, key) - 1 AS BIGINT) AS pos, key FROM sel")
def pln_4(spark, d):
    found = selection.candidates(nodes(spark, d), CAMERA)
    target = selection.target_depth(selection.depth_estimates(found, CAMERA), CAMERA)
    return selection.select_complete(found, CAMERA, target).select(F.col("pos").cast("bigint").alias("pos"), "key")


_CELL = "least(cells - 1, floor(((min_{a} + max_{a}) / 2 - min(min_{a}) OVER w) / greatest(max(max_{a}) OVER w - min(min_{a}) OVER w, pow(2, -52)) * cells))"
_PROGRESSIVE = _COMPLETE + f""", u AS (SELECT count(*) AS n, coalesce(sum(point_count), 0) AS p, max(depth) AS d FROM sel),
 r AS (SELECT greatest(0, 96 - n) AS most, greatest(0, 20000 - p) AS room, d, CAST(ceil(sqrt(greatest(0, 96 - n))) AS BIGINT) AS cells FROM u),
 dp AS (SELECT c.*, most, room, count(*) OVER w AS many, {_CELL.format(a="x")} * cells + {_CELL.format(a="y")} AS bucket FROM c, r WHERE c.depth > r.d AND most > 0 WINDOW w AS (PARTITION BY depth)),
 s1 AS (SELECT *, row_number() OVER (PARTITION BY depth, bucket ORDER BY dist, x, y, z, key) AS round, min(dist) OVER (PARTITION BY depth, bucket) AS near FROM dp),
 o AS (SELECT *, CASE WHEN many > most THEN row_number() OVER (PARTITION BY depth ORDER BY round, near, bucket) ELSE row_number() OVER (PARTITION BY depth ORDER BY dist, x, y, z, key) END AS i FROM s1),
 g(depth, i, taken, points, keys) AS (SELECT depth, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT depth FROM o)
 UNION ALL SELECT g.depth, o.i, CASE WHEN taken < most AND g.points + point_count <= room THEN taken + 1 ELSE taken END, CASE WHEN taken < most AND g.points + point_count <= room THEN g.points + point_count ELSE g.points END,
 CASE WHEN taken < most AND g.points + point_count <= room THEN list_append(keys, key) ELSE keys END FROM g JOIN o ON o.depth = g.depth AND o.i = g.i + 1),
 l AS (SELECT g.depth, keys FROM g JOIN (SELECT depth, max(i) AS i FROM o GROUP BY depth) m ON m.depth = g.depth AND m.i = g.i WHERE len(keys) > 0), b AS (SELECT keys FROM l, t ORDER BY abs(depth - target), -depth LIMIT 1)
 SELECT 'coverage' AS part, CAST(row_number() OVER (ORDER BY dist, x, y, z, key) - 1 AS BIGINT) AS pos, key FROM sel UNION ALL SELECT 'detail', CAST(p - 1 AS BIGINT), keys[p] FROM (SELECT keys, unnest(range(1, len(keys) + 1)) AS p FROM b)"""


@query("pln_5_progressive", NR + _PROGRESSIVE)
def pln_5(spark, d):
    found = selection.candidates(nodes(spark, d), CAMERA)
    target = selection.target_depth(selection.depth_estimates(found, CAMERA), CAMERA)
    return selection.select_progressive(found, CAMERA, target)


@query("win_2_spread_order", N + _EST + """, s AS (SELECT *, least(6, floor(((min_x + max_x) / 2) / 1000 * 7)) * 7 + least(6, floor(((min_y + max_y) / 2) / 1000 * 7)) AS bucket FROM c WHERE depth = 3),
 s2 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY dist, x, y, z, key) AS round, min(dist) OVER (PARTITION BY bucket) AS near, count(*) OVER () AS n FROM s)
 SELECT key, CAST(CASE WHEN n > 40 THEN row_number() OVER (ORDER BY round, near, bucket) ELSE row_number() OVER (ORDER BY dist, x, y, z, key) END AS BIGINT) AS place FROM s2""")
def win_2(spark, d):
    whole = nodes(spark, d).filter("depth = 3")
    # The cells are laid over the box of the depth, which the first and last node of each axis span.
    found = selection.candidates(whole, TIGHT)
    return selection.spread_order(found, TIGHT).select("key", F.col("place").cast("bigint").alias("place"))


def _siblings_sql(cameras: str, factor: int, wanted: str, ready: str) -> str:
    """Mixed-depth plans of cameras (cam, ex, ey, ez): the deepest whole cut that fits, then families by gain per cost, one per turn."""
    away = "sqrt(pow(greatest(min_x - ex, ex - max_x, 0), 2) + pow(greatest(min_y - ey, ey - max_y, 0), 2) + pow(greatest(min_z - ez, ez - max_z, 0), 2))"
    px = "(max_x - min_x) / greatest(away, max_x - min_x) * 1080"
    spx = f"{ROOT_SPACING} / (1 << depth) / greatest(away, {ROOT_SPACING} / (1 << depth)) * 1080"
    up = "a.depth <= n.depth AND n.x >> (n.depth - a.depth) = a.x AND n.y >> (n.depth - a.depth) = a.y AND n.z >> (n.depth - a.depth) = a.z"
    return f""", cams(cam, ex, ey, ez) AS (VALUES {cameras}), seen AS (SELECT n.*, cam, {away} AS away FROM nodes n, cams),
 v AS (SELECT cam, key, depth, x, y, z, point_count, {spx} * {factor} AS error, least(9007199254740991, {spx} * greatest(1, pow({px}, 2))) AS benefit, {ready} AS ready FROM seen),
 paths AS (SELECT n.key, count(*) = n.depth + 1 AS entire FROM nodes n JOIN nodes a ON {up} GROUP BY n.key, n.depth),
 cut AS (SELECT cam, d, bool_and(entire) AND count(*) <= 96 AND sum(point_count) <= 20000 AS good FROM v JOIN paths USING (key), (SELECT DISTINCT depth AS d FROM nodes) WHERE v.depth <= d AND d <= {wanted} GROUP BY cam, d),
 base AS (SELECT cam, max(d) AS d FROM cut WHERE good GROUP BY cam),
 fam AS (SELECT a.cam, a.key, a.depth, a.x, a.y, a.z, list(n.key) AS new, count(*) AS n, CAST(sum(n.point_count) AS BIGINT) AS p, round(list_sum(list(n.benefit ORDER BY n.z, n.y, n.x)), 3) AS g FROM v a JOIN v n ON n.cam = a.cam AND n.depth = a.depth + 1 AND n.x >> 1 = a.x AND n.y >> 1 = a.y AND n.z >> 1 = a.z GROUP BY a.cam, a.key, a.depth, a.x, a.y, a.z, a.error HAVING a.error >= 16 OR bool_or(n.error >= 16)),
 pick(cam, turn, taken, nodes, points) AS (SELECT v.cam, 0, list(key), CAST(count(*) AS BIGINT), CAST(sum(point_count) AS BIGINT) FROM v JOIN base ON base.cam = v.cam AND v.depth <= base.d GROUP BY v.cam
  UNION ALL SELECT cam, turn + 1, list_concat(taken, b.new), nodes + len(b.new), points + b.p FROM (
   SELECT *, (SELECT min(struct_pack(r := -(g / c), g := -g, c := c, d := -depth, z := z, y := y, x := x, k := key, new := new, p := p)) FROM (
    SELECT *, n / CAST(96 AS DOUBLE) + p / CAST(20000 AS DOUBLE) AS c FROM fam WHERE fam.cam = pick.cam AND list_contains(pick.taken, key) AND NOT list_has_any(pick.taken, new) AND pick.nodes + n <= 96 AND pick.points + p <= 20000)) AS b FROM pick) WHERE b IS NOT NULL),
 k AS (SELECT v.* FROM v JOIN (SELECT cam, unnest(max_by(taken, turn)) AS key FROM pick GROUP BY cam) USING (cam, key)),
 s AS (SELECT n.cam, n.key, n.depth, n.x, n.y, n.z, n.ready, bool_and(a.ready) AND count(*) = n.depth + 1 AS render FROM k n JOIN k a ON a.cam = n.cam AND {up} GROUP BY n.cam, n.key, n.depth, n.x, n.y, n.z, n.ready),
 f AS (SELECT n.*, EXISTS (SELECT 1 FROM s c WHERE c.cam = n.cam AND c.depth = n.depth + 1 AND c.x >> 1 = n.x AND c.y >> 1 = n.y AND c.z >> 1 = n.z) AS parent, EXISTS (SELECT 1 FROM s c WHERE c.cam = n.cam AND c.render AND c.depth = n.depth + 1 AND c.x >> 1 = n.x AND c.y >> 1 = n.y AND c.z >> 1 = n.z) AS drawn FROM s n) """


_ONE_CAMERA = _siblings_sql("(0, 500, 500, 1800)", 1, "(SELECT CASE WHEN target > 0 THEN greatest(1, target - 1) ELSE 0 END FROM t)", "true")


@query("pln_6_mixed_depth", NR + _EST + _ONE_CAMERA + "SELECT key, true AS planned, NOT parent AS frontier, render FROM f")
def pln_6(spark, d):
    return mixed_depth.select_mixed(nodes(spark, d), CAMERA).select("key", "planned", "frontier", "render")


_THREE_CAMERAS = _siblings_sql("(0, 200, 500, 1200), (1, 500, 500, 1200), (2, 800, 500, 1200)", 8, "1", "(x * 7 + y * 3 + z) % 5 <> 1 OR depth = 0")


@query("pln_7_traversal_sets", NR + _THREE_CAMERAS + "SELECT CAST(cam AS BIGINT) AS camera_id, key, true AS planned, NOT parent AS frontier, parent AS ancestor, render, NOT ready AS request, ready AND NOT render AS blocked, render AND NOT drawn AND parent AS retained_parent FROM f")
def pln_7(spark, d):
    """Several cameras over one catalog, each its own group; a fifth of the nodes isn't ready."""
    n = nodes(spark, d)
    unready = n.filter("(x * 7 + y * 3 + z) % 5 = 1 and depth > 0").select("key", F.lit(True).alias("unready"))
    views = None
    for i, x in enumerate((200.0, 500.0, 800.0)):
        camera = Camera(**(CAMERA.__dict__ | {"eye": (x, 500.0, 1200.0), "target": (x, 500.0, 1200.0)}))
        v = mixed_depth.view_states(selection.candidates(n, camera), camera).join(unready, "key", "left").withColumn("camera_id", F.lit(i).cast("bigint")).withColumn("error", F.col("error") * 8).withColumn("ready", F.col("unready").isNull())
        views = v if views is None else views.unionByName(v)
    return mixed_depth.plan_views(views.filter("visible"), mixed_depth.Budget(96, 20_000, None), 2)


_PX = "(max_x - min_x) / greatest(dist, max_x - min_x) * 1080"
_SPX = f"{ROOT_SPACING} / (1 << depth) / greatest(dist, {ROOT_SPACING} / (1 << depth)) * 1080"
_PLANNED = """SELECT CAST(0 AS BIGINT) AS camera_id, p.key, true AS planned, NOT parent AS frontier, parent AS ancestor, true AS render, false AS request, false AS blocked, false AS retained_parent FROM (SELECT p.key, EXISTS (SELECT 1 FROM taken k JOIN v ON v.key = k.key JOIN v o ON o.key = p.key WHERE v.depth = o.depth + 1 AND v.x >> 1 = o.x AND v.y >> 1 = o.y AND v.z >> 1 = o.z) AS parent FROM taken p) p"""
#: Each turn rates all nodes with the ancestors that they still need, and takes the best that fits.
_REFINED = _EST + f""", v AS (SELECT key, depth, x, y, z, point_count, {_SPX} * 8 AS error, least(9007199254740991, {_SPX} * greatest(1, pow({_PX}, 2))) AS benefit FROM c),
 w AS (SELECT *, depth = 0 OR error >= 16 AS worthy FROM v),
 path AS (SELECT n.key, n.depth, n.x, n.y, n.z, u.key AS up, u.depth AS up_depth, u.point_count AS points, CASE WHEN u.worthy THEN u.benefit ELSE 0 END AS benefit FROM w n JOIN w u ON u.depth <= n.depth AND n.x >> (n.depth - u.depth) = u.x AND n.y >> (n.depth - u.depth) = u.y AND n.z >> (n.depth - u.depth) = u.z WHERE n.worthy AND (SELECT count(*) FROM w a WHERE a.depth <= n.depth AND n.x >> (n.depth - a.depth) = a.x AND n.y >> (n.depth - a.depth) = a.y AND n.z >> (n.depth - a.depth) = a.z) = n.depth + 1),
 pick(turn, taken, nodes, points) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT turn + 1, list_concat(taken, b.new), nodes + len(b.new), points + b.p FROM (
   SELECT turn, taken, nodes, points, (SELECT min(struct_pack(r := -(g / c), g := -g, c := c, d := -depth, z := z, y := y, x := x, k := key, new := new, p := p)) FROM (
    SELECT *, n / CAST(24 AS DOUBLE) + p / CAST(10000 AS DOUBLE) AS c FROM (SELECT key, depth, x, y, z, list(up ORDER BY up_depth) AS new, count(*) AS n, CAST(sum(points) AS BIGINT) AS p, round(list_sum(list(benefit ORDER BY up_depth)), 3) AS g FROM path WHERE NOT list_contains(pick.taken, up) GROUP BY ALL)
    WHERE list_contains(new, key) AND pick.nodes + n <= 24 AND pick.points + p <= 10000)) AS b FROM pick) WHERE b IS NOT NULL),
 taken AS (SELECT unnest(taken) AS key FROM pick WHERE turn = (SELECT max(turn) FROM pick)) """


@query("pln_8_node_refinement", NR + _REFINED + _PLANNED)
def pln_8(spark, d):
    found = selection.candidates(nodes(spark, d), CAMERA)
    views = mixed_depth.view_states(found, CAMERA).withColumn("error", F.col("error") * 8)
    return mixed_depth.plan_views(views.filter("visible"), mixed_depth.Budget(24, 10_000, None), 2, siblings=False)


@query("pln_9_coverage_errors", "SELECT * FROM (VALUES (1, 'unknown-node'), (2, 'non-renderable-node'), (3, 'missing-ancestor'), (4, 'budget-exceeded'), (5, 'ok')) AS t(id, code)")
def pln_9(spark, d):
    catalog = {n.key: n for n in (mixed_depth.Node("0-0-0-0", 10, 360), mixed_depth.Node("1-0-0-0", 0, 0), mixed_depth.Node("1-1-0-0", 10, 360), mixed_depth.Node("3-0-0-0", 10, 360))}

    def code(required: list[str], budget: mixed_depth.Budget) -> str:
        try:
            mixed_depth.required_cover(required, catalog, budget)
            return "ok"
        except mixed_depth.RequiredCoverageError as e:
            return e.code

    free = mixed_depth.Budget()
    rows = [(1, code(["2-0-0-0"], free)), (2, code(["1-0-0-0"], free)), (3, code(["3-0-0-0"], free)), (4, code(["1-1-0-0"], mixed_depth.Budget(nodes=1))), (5, code(["1-1-0-0"], free))]
    return spark.createDataFrame(rows, "id int, code string")


@query("pln_10_render_plan", N + _CLOSED + " SELECT CAST(count(*) AS BIGINT) AS render_nodes, CAST(count(*) FILTER (WHERE depth = (SELECT max(depth) FROM closed)) AS BIGINT) AS final_nodes, CAST(least(180000, ceil(20000.0 / count(*))) AS BIGINT) AS points_per_node, string_agg(key, '|' ORDER BY key) AS signature FROM closed")
def pln_10(spark, d):
    closed = PointCloud.load(spark, d).select(CAMERA)
    top = closed.agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("render_nodes"))
    final = closed.crossJoin(F.broadcast(top)).agg(F.first("render_nodes").alias("render_nodes"), F.count_if(F.col("depth") == F.col("deepest")).alias("final_nodes"))
    share = render_plan.points_per_node(F.lit(180_000), F.lit(20_000), F.col("render_nodes"))
    return final.crossJoin(render_plan.signature(closed)).select("render_nodes", "final_nodes", share.cast("bigint").alias("points_per_node"), "signature")


@query("pln_11_coverage_keys", N + " SELECT key FROM nodes WHERE depth <= 1")
def pln_11(spark, d):
    return render_plan.coverage_keys(nodes(spark, d), 3).select("key")


@query("pln_11_preview_keys", NR + """, k AS (SELECT key, data_length, row_number() OVER (ORDER BY depth, z, y, x) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE depth = 2), m AS (SELECT least(12, any_value(n)) AS m, any_value(n) AS n FROM k),
 p AS (SELECT pick + 1 AS pick, key, data_length FROM (SELECT unnest(range(m)) AS pick, m, n FROM m) JOIN k ON k.i = floor(pick * (m.n - 1) / CAST(m - 1 AS DOUBLE) + 0.5)),
 w(pick, bytes, took, key, cnt) AS (SELECT pick, CAST(data_length AS HUGEINT), true, key, 1 FROM p WHERE pick = 1 UNION ALL SELECT p.pick, CASE WHEN w.bytes + p.data_length <= 4000 THEN w.bytes + p.data_length ELSE w.bytes END, w.bytes + p.data_length <= 4000, p.key, CASE WHEN w.bytes + p.data_length <= 4000 THEN w.cnt + 1 ELSE w.cnt END FROM w JOIN p ON p.pick = w.pick + 1)
 SELECT CAST(cnt - 1 AS BIGINT) AS pos, key FROM w WHERE took""".replace("m.n - 1", "n_1").replace("(SELECT unnest(range(m)) AS pick, m, n FROM m)", "(SELECT unnest(range(m)) AS pick, m, n - 1 AS n_1 FROM m)").replace("CAST(m - 1 AS DOUBLE)", "CAST(m - 1 AS DOUBLE)"))
def pln_11_preview(spark, d):
    from pyspark.sql import Window

    k = nodes(spark, d).filter("depth = 2").withColumn("pos", F.row_number().over(Window.orderBy("depth", "z", "y", "x")))
    return render_plan.preview_keys(k, 12, 4000).select(F.col("pos").cast("bigint").alias("pos"), "key")


@query("pln_12_prefetch", N + " SELECT key FROM (SELECT *, (depth = 3 AND x = 1) AS first FROM nodes WHERE NOT (depth <= 1 OR x % 2 = 0)) ORDER BY first DESC, point_count DESC, key LIMIT 32")
def pln_12(spark, d):
    n = nodes(spark, d)
    return render_plan.prefetch_keys(n, n.filter("depth <= 1 or x % 2 = 0"), n.filter("depth = 3 and x = 1"), 32)


@query("pln_12_prefetch_targets", "SELECT CAST(depth AS BIGINT) AS depth, CAST(greatest(24, px * 0.6) AS DOUBLE) AS node_pixels, CAST(greatest(1, spx * 0.6) AS DOUBLE) AS spacing_pixels FROM (VALUES (4, CAST(80 AS DOUBLE), CAST(4 AS DOUBLE)), (5, 30, 1.5), (5, 48, 2)) AS t(depth, px, spx)")
def pln_12_targets(spark, d):
    rows = [settings.Prefetch.of(dep, px, spx, 5) for dep, px, spx in ((3, 80.0, 4.0), (4, 30.0, 1.5), (5, 48.0, 2.0))]
    return spark.createDataFrame([(r.depth, r.node_pixels, r.spacing_pixels) for r in rows], "depth bigint, node_pixels double, spacing_pixels double")


_B = settings.BANDS


def _case(f, above) -> str:
    return "CASE " + " ".join(f"WHEN h <= {b.top} THEN {f(b)!r}" for b in _B) + f" ELSE {above!r} END"


_Q = settings.PRESETS["balanced"]


@query("pln_13_lod_settings", f"""WITH e AS (SELECT event_id, 10 * value AS h FROM events) SELECT event_id, {_case(lambda b: b.label, 'overview')} AS label, CAST({_case(lambda b: _Q.nodes * b.node_factor, _Q.nodes)} AS BIGINT) AS max_nodes, CAST({_case(lambda b: max(_Q.depth, b.least_depth), _Q.depth)} AS BIGINT) AS max_depth,
 CAST({_case(lambda b: min(_Q.spacing_pixels, b.spacing_pixels), _Q.spacing_pixels)} AS DOUBLE) AS spacing_pixels, CAST({_case(lambda b: _Q.rendered_points * b.point_factor, _Q.rendered_points)} AS BIGINT) AS rendered_points, CAST({_case(lambda b: max(2, b.pages), 2)} AS BIGINT) AS pages, CAST({_case(lambda b: b.node_target, 5000)} AS BIGINT) AS node_target FROM e""")
def pln_13(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") * 10).alias("height"))
    return settings.lod_settings(e).select("event_id", "label", "max_nodes", "max_depth", "spacing_pixels", "rendered_points", "pages", "node_target")


@query("pln_14_quality_presets", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({q.rendered_points} AS BIGINT), CAST({q.source_points} AS BIGINT), CAST({q.source_bytes} AS BIGINT), CAST({q.nodes} AS BIGINT), CAST({q.depth} AS BIGINT))" for n, q in settings.PRESETS.items()) + ") AS t(preset, rendered_points, source_points, source_bytes, nodes, depth)")
def pln_14(spark, d):
    return settings.presets(spark).select("preset", "rendered_points", "source_points", "source_bytes", "nodes", "depth")


@query("pln_15_expanded_pages", N + f", c AS (SELECT *, sqrt(pow(greatest(min_x - 500, 500 - max_x, 0), 2) + pow(greatest(min_y - 500, 500 - max_y, 0), 2)) AS d2 FROM nodes), a AS (SELECT key, x, y, z FROM c WHERE depth = 1 ORDER BY d2, depth, key LIMIT 4), b AS (SELECT c.key FROM c JOIN a ON c.depth = 2 AND c.x >> 1 = a.x AND c.y >> 1 = a.y AND c.z >> 1 = a.z ORDER BY d2, c.depth, c.key LIMIT 2) SELECT key FROM a UNION ALL SELECT key FROM b")
def pln_15(spark, d):
    """Rounds of page loading: four pages of depth 1, then two of those that they reveal."""
    from stratacloud.plans.expansion import expand

    return expand(nodes(spark, d), (500.0, 500.0), first_depth=1, rounds=(4, 2))


@query("pln_16_thresholds", "SELECT event_id, round(value * 0.75, 6) AS settled, CAST(least(4, event_id % 7) AS BIGINT) AS expand_to FROM events")
def pln_16(spark, d):
    return table(spark, d, "events").select("event_id", F.round(settings.settled_threshold(F.col("value")), 6).alias("settled"), settings.expansion_depth(F.lit(4), F.col("event_id") % 7).cast("bigint").alias("expand_to"))


@query("pln_17_worker_budgets", "SELECT event_id, CAST(least(4, greatest(1, event_id % 12 - 2)) AS BIGINT) AS workers, CAST(least(201326592, floor(536870912.0 / least(4, greatest(1, event_id % 12 - 2)))) AS BIGINT) AS bytes FROM events")
def pln_17(spark, d):
    w = settings.worker_count(F.col("event_id") % 12)
    return table(spark, d, "events").select("event_id", w.cast("bigint").alias("workers"), settings.worker_bytes(F.lit(536_870_912), w).cast("bigint").alias("bytes"))


@query("pln_18_runtime_settings", "SELECT * FROM (VALUES ('debounce_ms', CAST(30 AS DOUBLE)), ('preview_points', 64000), ('preview_points_per_node', 8000), ('retained_samples', 1024), ('reuse_overlap', 0.35)) AS t(name, value)")
def pln_18(spark, d):
    from dataclasses import asdict

    return spark.createDataFrame([(k, float(v)) for k, v in asdict(settings.Runtime()).items()], "name string, value double")
