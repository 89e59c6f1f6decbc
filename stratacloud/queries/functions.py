"""Scalar functions, projections and predicates (FN, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.fixtures import CUBE, NODES_SQL, POINTS_SQL, ROOT_SPACING, nodes, points, table
from stratacloud.functions import color, crs, geometry, keys, morton, status
from stratacloud.queries import query

EYE = (500.0, 500.0, 1800.0)
VIEWPORT = 1080.0
COS_CONE = 0.8660254037844387
DIRECTION = (0.0, 0.0, -1.0)


def eye():
    return tuple(F.lit(v) for v in EYE)


def r6(c):
    return F.round(c, 6)


P, N = "WITH " + POINTS_SQL, "WITH " + NODES_SQL
#: Horizontal degrees of the test cloud: the cube laid over a degree of land.
LON, LAT = "(-121.0 + x / 1000)", "(44.0 + y / 1000)"


def lonlat():
    return F.lit(-121.0) + F.col("x") / 1000, F.lit(44.0) + F.col("y") / 1000


@query("fn_1_color_component", P + "SELECT point_id, CAST(greatest(0, least(255, CASE WHEN v > 255 THEN floor(v / 257.0 + 0.5) ELSE floor(v + 0.5) END)) AS INTEGER) AS c FROM (SELECT point_id, (point_id * 37) % 66000 - 100 AS v FROM points)")
def fn_1(spark, d):
    v = (F.col("point_id") * 37) % 66000 - 100
    return points(spark, d).select("point_id", color.color_component(v).alias("c"))


@query("fn_2_class_intensity", P + """SELECT point_id, CAST(greatest(0, least(255, floor(coalesce(classification, 0) * 60.5 + 0.5))) AS INTEGER) AS class_u8,
  CAST(CASE WHEN intensity IS NULL THEN 0 ELSE greatest(0, least(65535, floor(intensity * 1.25 - 50 + 0.5))) END AS INTEGER) AS intensity_u16 FROM points""")
def fn_2(spark, d):
    return points(spark, d).select("point_id", color.unsigned(F.coalesce("classification", F.lit(0)) * 60.5, 255).alias("class_u8"), color.unsigned(F.col("intensity") * 1.25 - 50, 65535).alias("intensity_u16"))


_PALETTE = "(VALUES " + ", ".join(f"({k}, {color.pack(*c)})" for k, c in color.CLASS_COLORS.items()) + ") AS pal(cls, rgb)"
_ATTR = f"""CASE WHEN red IS NOT NULL THEN (red << 16) | (green << 8) | blue WHEN rgb IS NOT NULL THEN rgb
  WHEN intensity IS NOT NULL THEN CAST(floor(48 + sqrt(intensity / CAST(65535 AS DOUBLE)) * 207 + 0.5) AS BIGINT) * 65793
  WHEN classification IS NULL THEN {color.pack(*color.CYAN)} ELSE {color.pack(*color.NEUTRAL)} END"""


@query("fn_3_attribute_color", P + f"SELECT point_id, CAST({_ATTR} AS BIGINT) AS rgb FROM points LEFT JOIN {_PALETTE} ON cls = classification")
def fn_3(spark, d):
    c = color.attribute_color(*[F.col(n) for n in ("red", "green", "blue", "classification", "intensity")])
    return points(spark, d).select("point_id", c.cast("bigint").alias("rgb"))


@query("fn_4_class_palette", f"SELECT CAST(cls AS INTEGER) AS classification, CAST(rgb AS BIGINT) AS rgb FROM {_PALETTE}")
def fn_4(spark, d):
    return spark.createDataFrame([(k, color.pack(*c)) for k, c in color.CLASS_COLORS.items()], "classification int, rgb bigint")


def _stop(k: int, name: str) -> str:
    values = "[" + ", ".join(f"CAST({s[k]} AS DOUBLE)" for s in color.ELEVATION_STOPS) + "]"
    return f"CAST(floor({values}[lo + 1] + ({values}[least(lo + 1, 5) + 1] - {values}[lo + 1]) * (t - lo) + 0.5) AS BIGINT) AS {name}"


@query("fn_5_elevation_color", P + f""", e AS (SELECT point_id, 5 * greatest(0, least(1, (z - z_low) / (z_high - z_low))) AS t FROM points, (SELECT min(z) AS z_low, max(z) AS z_high FROM points)),
  f AS (SELECT point_id, t, CAST(least(floor(t), 5) AS BIGINT) AS lo FROM e), g AS (SELECT point_id, {_stop(0, 'r')}, {_stop(1, 'g')}, {_stop(2, 'b')} FROM f)
  SELECT point_id, (r << 16) | (g << 8) | b AS rgb FROM g""")
def fn_5(spark, d):
    p = points(spark, d)
    box = p.agg(F.min("z").alias("z_low"), F.max("z").alias("z_high"))
    rgb = color.elevation_color(color.elevation_position(F.col("z"), F.col("z_low"), F.col("z_high")))
    return p.crossJoin(F.broadcast(box)).select("point_id", rgb.cast("bigint").alias("rgb"))


@query("fn_6_pack_unpack", P + "SELECT point_id, (red << 16) | (green << 8) | blue AS packed, red AS r, green AS g, blue AS b FROM points WHERE red IS NOT NULL")
def fn_6(spark, d):
    p = points(spark, d).filter("red is not null").select("point_id", color.pack_rgb(F.col("red"), F.col("green"), F.col("blue")).alias("packed"))
    r, g, b = color.unpack_rgb(F.col("packed"))
    return p.select("point_id", F.col("packed").cast("bigint").alias("packed"), r.cast("bigint").alias("r"), g.cast("bigint").alias("g"), b.cast("bigint").alias("b"))


_L = crs.EPSG_2992
_T = f"(tan(pi() / 4 - radians({LAT}) / 2) / pow((1 - {_L.e!r} * sin(radians({LAT}))) / (1 + {_L.e!r} * sin(radians({LAT}))), {_L.e / 2!r}))"
_RHO = f"({crs.GRS80_A * _L.f!r} * pow({_T}, {_L.n!r}))"
_THETA = f"({_L.n!r} * (radians({LON}) - ({_L.lon0!r})))"


@query("fn_7_projected_to_degrees", P + f"SELECT point_id, round({LON}, 6) AS lon, round({LAT}, 6) AS lat FROM points")
def fn_7(spark, d):
    """Forward to EPSG:2992 and back: the inverse must return the degrees it began with."""
    x, y = _L.forward(*lonlat())
    p = points(spark, d).select("point_id", x.alias("px"), y.alias("py"))
    lon, lat = _L.inverse(F.col("px"), F.col("py"))
    return p.select("point_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("fn_8_scaled_transform", P + f"SELECT point_id, round({LON}, 6) AS lon, round({LAT}, 6) AS lat, round(z * 0.3048, 6) AS height FROM points")
def fn_8(spark, d):
    from stratacloud.api import projected_transform

    lon, lat, h = projected_transform(lambda x, y: (F.lit(-121.0) + x / 1000, F.lit(44.0) + y / 1000), height_scale=0.3048)(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, d).select("point_id", r6(lon).alias("lon"), r6(lat).alias("lat"), r6(h).alias("height"))


WKTS = [
    (1, 'PROJCS["Oregon",GEOGCS["NAD83",AUTHORITY["EPSG","4269"]],UNIT["foot",0.3048],AUTHORITY["EPSG","2992"]]'),
    (2, 'COMPD_CS["c",PROJCS["UTM [10N]",GEOGCS["g"],AUTHORITY["EPSG","26910"]],VERT_CS["NAVD88 height (ftUS)",UNIT["US survey foot",0.3048006096012192]]]'),
    (3, 'GEOGCRS["WGS 84",ID["EPSG",4326]]'),
    (4, 'COMPD_CS["d",PROJCS["p"],VERT_CS["NAVD88 height (ftUS)"]]'),
    (5, None),
]


def _wkts(spark):
    return spark.createDataFrame(WKTS, "id int, wkt string")


_WKT_SQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if w is None else chr(39) + w + chr(39)})" for i, w in WKTS) + ") AS w(id, wkt)"


@query("fn_9_crs_status", f"""SELECT id, CAST(coalesce(contains(wkt, 'AUTHORITY["EPSG","2992"]'), false) AS BOOLEAN) AS is_2992,
  CASE WHEN coalesce(contains(wkt, 'AUTHORITY["EPSG","2992"]'), false) THEN 'epsg:2992' WHEN wkt IS NOT NULL THEN 'wkt' ELSE 'geographic' END AS status FROM {_WKT_SQL}""")
def fn_9(spark, d):
    box = [F.lit(v) for v in (-121.0, 44.0, -120.0, 45.0)]
    return _wkts(spark).select("id", crs.is_epsg_2992(F.col("wkt")).alias("is_2992"), crs.crs_status(F.col("wkt"), *box).alias("status"))


@query("fn_10_horizontal_wkt", "SELECT * FROM (VALUES (1, 'PROJCS[', ']]'), (2, 'PROJCS[', ']]'), (3, 'GEOGCRS', ']]'), (4, 'PROJCS[', '\"]')) AS t(id, head, tail)")
def fn_10(spark, d):
    got = _wkts(spark).filter("wkt is not null").select("id", crs.horizontal_wkt(F.col("wkt")).alias("w"))
    return got.select("id", F.substring("w", 1, 7).alias("head"), F.expr("right(w, 2)").alias("tail"))


@query("fn_11_epsg_and_height", f"""SELECT id, CASE id WHEN 1 THEN 'EPSG:2992' WHEN 2 THEN 'EPSG:26910' WHEN 3 THEN 'EPSG:4326' END AS epsg,
  CAST(CASE id WHEN 2 THEN 0.3048006096012192 WHEN 4 THEN 0.304800609601219 ELSE 1.0 END AS DOUBLE) AS height_scale FROM {_WKT_SQL}""")
def fn_11(spark, d):
    return _wkts(spark).select("id", crs.epsg_code(F.col("wkt")).alias("epsg"), crs.height_scale(F.col("wkt")).alias("height_scale"))


_N84 = f"({geometry.SEMI_MAJOR} / sqrt(1 - {geometry.FIRST_ECCENTRICITY_SQUARED!r} * sin(radians({LAT})) * sin(radians({LAT}))))"


@query("fn_12_ecef", P + f"""SELECT point_id, round(({_N84} + z) * cos(radians({LAT})) * cos(radians({LON})), 4) AS ex, round(({_N84} + z) * cos(radians({LAT})) * sin(radians({LON})), 4) AS ey,
  round(({_N84} * (1 - {geometry.FIRST_ECCENTRICITY_SQUARED!r}) + z) * sin(radians({LAT})), 4) AS ez FROM points""")
def fn_12(spark, d):
    x, y, z = geometry.ecef(*lonlat(), F.col("z"))
    return points(spark, d).select("point_id", F.round(x, 4).alias("ex"), F.round(y, 4).alias("ey"), F.round(z, 4).alias("ez"))


@query("fn_13_affine_transform", P + f""", a AS (SELECT node_key, min_by(x, point_id) AS ax, min_by(y, point_id) AS ay FROM points GROUP BY node_key)
  SELECT point_id, round((-121.0 + ax / 1000) + (x - ax) * 0.001, 6) AS lon, round((44.0 + ay / 1000) + (y - ay) * 0.001, 6) AS lat FROM points JOIN a USING (node_key)""")
def fn_13(spark, d):
    """Per node the exact transform at its first finite point and one unit beside it, carried on linearly."""
    from pyspark.sql import Window

    to = lambda x, y: (F.lit(-121.0) + x / 1000, F.lit(44.0) + y / 1000)
    w = Window.partitionBy("node_key").orderBy("point_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = geometry.finite(F.col("x")) & geometry.finite(F.col("y"))
    p = points(spark, d).select("point_id", "x", "y", F.first(F.when(ok, F.col("x")), ignorenulls=True).over(w).alias("ax"), F.first(F.when(ok, F.col("y")), ignorenulls=True).over(w).alias("ay"))
    ax, ay, dx, dy = F.col("ax"), F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    at, sx, sy = to(ax, ay), to(ax + 1, ay), to(ax, ay + 1)
    out = [at[i] + dx * (sx[i] - at[i]) + dy * (sy[i] - at[i]) for i in (0, 1)]
    return p.select("point_id", r6(out[0]).alias("lon"), r6(out[1]).alias("lat"))


def _spacing(spark, d):
    n = nodes(spark, d)
    s = ROOT_SPACING / F.pow(F.lit(2.0), F.col("depth"))
    mid = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"]
    to = lambda x, y, z: geometry.ecef(F.lit(-121.0) + x / 1000, F.lit(44.0) + y / 1000, z)
    dist = lambda p, q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]))
    o = to(*mid)
    return n.withColumn("spacing_m", (dist(o, to(mid[0] + s, mid[1], mid[2])) + dist(o, to(mid[0], mid[1] + s, mid[2]))) / 2)


def _ecef_sql(x: str, y: str, z: str) -> list[str]:
    lon, lat = f"radians(-121.0 + ({x}) / 1000)", f"radians(44.0 + ({y}) / 1000)"
    n = f"({geometry.SEMI_MAJOR} / sqrt(1 - {geometry.FIRST_ECCENTRICITY_SQUARED!r} * sin({lat}) * sin({lat})))"
    return [f"(({n} + {z}) * cos({lat}) * cos({lon}))", f"(({n} + {z}) * cos({lat}) * sin({lon}))", f"(({n} * (1 - {geometry.FIRST_ECCENTRICITY_SQUARED!r}) + {z}) * sin({lat}))"]


def _dist_sql(p: list[str], q: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(p, q)) + ")"


_O, _SX, _SY = (_ecef_sql(x, y, "((min_z + max_z) / 2)") for x, y in (("(min_x + max_x) / 2", "(min_y + max_y) / 2"), ("(min_x + max_x) / 2 + s", "(min_y + max_y) / 2"), ("(min_x + max_x) / 2", "(min_y + max_y) / 2 + s")))
_SPACING_SQL = N + f", sp AS (SELECT *, ({_dist_sql(_O, _SX)} + {_dist_sql(_O, _SY)}) / 2 AS spacing_m FROM (SELECT *, {ROOT_SPACING} / (1 << depth) AS s FROM nodes))"


@query("fn_14_point_spacing", _SPACING_SQL + " SELECT key, round(spacing_m, 4) AS spacing_m, CAST(least(1.0, 100.0 / point_count) AS DOUBLE) AS density_scale FROM sp")
def fn_14(spark, d):
    return _spacing(spark, d).select("key", F.round("spacing_m", 4).alias("spacing_m"), F.least(F.lit(1.0), F.lit(100.0) / F.col("point_count")).alias("density_scale"))


@query("fn_15_effective_spacing", _SPACING_SQL + " SELECT key, round(spacing_m / sqrt(least(1.0, 100.0 / point_count)), 4) AS spacing_m FROM sp")
def fn_15(spark, d):
    return _spacing(spark, d).select("key", F.round(F.col("spacing_m") / F.sqrt(F.least(F.lit(1.0), F.lit(100.0) / F.col("point_count"))), 4).alias("spacing_m"))


@query("fn_16_key_bounds", N + "SELECT key, depth, x, y, z, min_x, min_y, min_z, max_x, max_y, max_z, round(density, 9) AS density FROM nodes")
def fn_16(spark, d):
    k = keys.parse_key(F.col("key"))
    n = nodes(spark, d).select("key", "point_count", *[c.alias(a) for a, c in k.items()])
    box = keys.node_bounds(F.col("depth"), F.col("x"), F.col("y"), F.col("z"), CUBE)
    n = n.select("*", *[c.alias(a) for a, c in box.items()])
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    return n.select("key", "depth", "x", "y", "z", *box, F.round(F.col("point_count") / F.greatest(volume, F.lit(geometry.EPSILON)), 9).alias("density"))


@query("fn_17_ancestors", N + """SELECT key, array_to_string(list_transform(range(depth + 1), lambda k: k || '-' || (x >> (depth - k)) || '-' || (y >> (depth - k)) || '-' || (z >> (depth - k))), ',') AS ancestors,
  CASE WHEN depth > 0 THEN (depth - 1) || '-' || (x >> 1) || '-' || (y >> 1) || '-' || (z >> 1) END AS parent, x < (1 << (depth - 0)) AND key LIKE '0-%' OR (depth >= 1 AND x >> (depth - 1) = 0 AND y >> (depth - 1) = 0 AND z >> (depth - 1) = 0) AS under_1_0_0_0 FROM nodes WHERE depth > 0""")
def fn_17(spark, d):
    n = nodes(spark, d).filter("depth > 0")
    return n.select("key", F.array_join(keys.ancestor_keys(F.col("key")), ",").alias("ancestors"), keys.parent_key(F.col("key")).alias("parent"), keys.is_ancestor(F.lit("1-0-0-0"), F.col("key")).alias("under_1_0_0_0"))


@query("fn_18_key_depth", f"SELECT k, CASE k WHEN 'x' THEN {keys.NO_DEPTH} WHEN '' THEN {keys.NO_DEPTH} ELSE CAST(split_part(k, '-', 1) AS BIGINT) END AS depth FROM (VALUES ('0-0-0-0'), ('3-1-2-3'), ('12-0-0-1'), ('x'), ('')) AS t(k)")
def fn_18(spark, d):
    return spark.createDataFrame([("0-0-0-0",), ("3-1-2-3",), ("12-0-0-1",), ("x",), ("",)], "k string").select("k", keys.key_depth(F.col("k")).alias("depth"))


def _q_sql(a: str) -> str:
    return f"CAST(greatest(0, least(1023, floor(({a} - min({a}) OVER (PARTITION BY node_key)) / (max({a}) OVER (PARTITION BY node_key) - min({a}) OVER (PARTITION BY node_key)) * 1023 + 0.5))) AS BIGINT)"


def _flat_sql(a: str) -> str:
    return f"CASE WHEN max({a}) OVER (PARTITION BY node_key) <= min({a}) OVER (PARTITION BY node_key) THEN 0 ELSE {_q_sql(a)} END AS q{a}"


MORTON_SQL = POINTS_SQL + f""", q AS (SELECT *, {_flat_sql('x')}, {_flat_sql('y')}, {_flat_sql('z')} FROM points),
 m AS (SELECT *, CAST(list_sum(list_transform(range(10), lambda i: (((qx >> i) & 1) << (3 * i)) + (((qy >> i) & 1) << (3 * i + 1)) + (((qz >> i) & 1) << (3 * i + 2)))) AS BIGINT) AS morton FROM q)"""


@query("fn_19_morton", "WITH " + MORTON_SQL + " SELECT point_id, morton FROM m")
def fn_19(spark, d):
    return morton.progressive_order(points(spark, d), "node_key", "point_id").select("point_id", "morton")


@query("fn_20_reverse_bits", P + "SELECT point_id, CAST(list_sum(list_transform(range(17), lambda i: ((point_id % 131072 >> i) & 1) << (16 - i))) AS BIGINT) AS reversed FROM points")
def fn_20(spark, d):
    return points(spark, d).select("point_id", morton.reverse_bits(F.col("point_id") % 131072, F.lit(17)).alias("reversed"))


_D3 = "sqrt(pow(greatest(min_x - 500, 500 - max_x, 0), 2) + pow(greatest(min_y - 500, 500 - max_y, 0), 2) + pow(greatest(min_z - 1800, 1800 - max_z, 0), 2))"
_D2 = "sqrt(pow(greatest(min_x - 500, 500 - max_x, 0), 2) + pow(greatest(min_y - 500, 500 - max_y, 0), 2))"


@query("fn_21_box_distance", N + f"SELECT key, round({_D3}, 6) AS d3, round({_D2}, 6) AS d2 FROM nodes")
def fn_21(spark, d):
    x, y, z = eye()
    return nodes(spark, d).select("key", r6(geometry.box_distance(x, y, z)).alias("d3"), r6(geometry.box_distance(x, y)).alias("d2"))


@query("fn_22_screen_pixels", N + f"SELECT key, round((max_x - min_x) / greatest({_D3}, max_x - min_x) * 1080, 6) AS node_px, round({ROOT_SPACING} / (1 << depth) / greatest({_D3}, {ROOT_SPACING} / (1 << depth)) * 1080, 6) AS spacing_px FROM nodes")
def fn_22(spark, d):
    dist = geometry.box_distance(*eye())
    s = ROOT_SPACING / F.pow(F.lit(2.0), F.col("depth"))
    return nodes(spark, d).select("key", r6(geometry.screen_pixels(geometry.horizontal_span(), dist, VIEWPORT)).alias("node_px"), r6(geometry.screen_pixels(s, dist, VIEWPORT)).alias("spacing_px"))


_CONE = f"""(dist <= radius OR acos(greatest(least(((min_z + max_z) / 2 - 1800) * -1 / dist, 1), -1)) - CASE WHEN dist > radius THEN asin(radius / dist) ELSE pi() END <= acos({COS_CONE}))"""
_CONE_FROM = "(SELECT *, sqrt(pow((min_x + max_x) / 2 - 500, 2) + pow((min_y + max_y) / 2 - 500, 2) + pow((min_z + max_z) / 2 - 1800, 2)) AS dist, sqrt(3 * pow((max_x - min_x) / 2, 2)) AS radius FROM nodes)"


@query("fn_23_view_cone", N + f"SELECT key, {_CONE} AS seen FROM {_CONE_FROM}")
def fn_23(spark, d):
    return nodes(spark, d).select("key", geometry.in_view_cone(*eye(), DIRECTION, COS_CONE).alias("seen"))


@query("fn_24_camera_height", """WITH c AS (SELECT event_id, 10 * value AS h FROM events) SELECT event_id, round(greatest(0, h - 1000), 6) AS above_m,
  CAST(greatest(1200, 2.5 * 1000, 4 * 1000) AS DOUBLE) AS default_height FROM c""")
def fn_24(spark, d):
    from stratacloud.plans.settings import default_camera_height, height_above

    e = table(spark, d, "events")
    return e.select("event_id", r6(height_above(F.col("value") * 10, F.lit(CUBE[5]))).alias("above_m"), default_camera_height(F.lit(1000.0), F.lit(1000.0)).alias("default_height"))


@query("fn_25_camera_to_source", "SELECT event_id, round(value, 6) AS x, round(value * 2, 6) AS y, round(least(10000, greatest(100, 0.02 * abs(value * 10))), 6) AS step FROM events")
def fn_25(spark, d):
    from stratacloud.plans.settings import camera_to_source, direction_step

    e = table(spark, d, "events").withColumn("lon", F.lit(-121.0) + F.col("value") / 1000).withColumn("lat", F.lit(44.0) + F.col("value") * 2 / 1000)
    x, y = camera_to_source(F.col("lon"), F.col("lat"), lambda a, b: ((a + 121.0) * 1000, (b - 44.0) * 1000))
    return e.select("event_id", r6(x).alias("x"), r6(y).alias("y"), r6(direction_step(F.col("value") * 10)).alias("step"))


@query("fn_26_byte_sizes", P + "SELECT node_key, CAST(count(*) * 28 AS BIGINT) AS payload, CAST(count(*) * (24 + CASE WHEN count(red) > 0 THEN 3 ELSE 0 END + CASE WHEN count(classification) > 0 THEN 1 ELSE 0 END + CASE WHEN count(intensity) > 0 THEN 2 ELSE 0 END) AS BIGINT) AS sample FROM points GROUP BY node_key")
def fn_26(spark, d):
    has = lambda c, n: F.when(F.count(c) > 0, n).otherwise(0)
    n = F.count(F.lit(1))
    return points(spark, d).groupBy("node_key").agg((n * 28).alias("payload"), (n * (F.lit(24) + has("red", 3) + has("classification", 1) + has("intensity", 2))).alias("sample"))


@query("fn_27_row_to_columns", P + "SELECT node_key, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(red, 0)) AS BIGINT) AS red_sum, CAST(sum(coalesce(green, 255)) AS BIGINT) AS green_sum, CAST(sum(coalesce(classification, 0)) AS BIGINT) AS class_sum FROM points GROUP BY node_key")
def fn_27(spark, d):
    """Rows to channels and back: colours that are missing become the default, classes 0."""
    from stratacloud.operators.sampling import to_channels, to_rows

    rows = to_rows(to_channels(points(spark, d)))
    return rows.groupBy("node_key").agg(F.count(F.lit(1)).alias("n"), F.sum("red").cast("bigint").alias("red_sum"), F.sum("green").cast("bigint").alias("green_sum"), F.sum("classification").cast("bigint").alias("class_sum"))


#: Whole numbers with separators, and decimals without trailing zeros, for the checking engine.
def _num(c: str) -> str:
    return f"format('{{:,}}', CAST(({c}) AS BIGINT))"


def _dec(c: str, digits: int) -> str:
    return f"regexp_replace(format('{{:,.{digits}f}}', CAST({c} AS DOUBLE)), '\\.?0+$', '')"


def _cap(now: str, most: str, label: str) -> str:
    return f"CASE WHEN {now} = {most} THEN {_num(most)} || ' {label}' ELSE {_num(now)} || ' / ' || {_num(most)} || ' {label} adaptive' END"


_BY_DEPTH = ", g AS (SELECT depth, count(*) AS n, CAST(sum(point_count) AS BIGINT) AS p, CAST(sum(data_length) AS BIGINT) AS b FROM nodes GROUP BY depth) "


def _by_depth(spark, d):
    return nodes(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("point_count").alias("p"), F.sum("data_length").alias("b"))


@query("fn_28_status_lines", N.rstrip() + _BY_DEPTH + f"""SELECT depth, 'expand ' || {_num("n")} || ' ms, apply ' || {_num("n * 2")} || ' ms, select ' || {_num("n * 3")} || ' ms, render ' || {_num("n * 1000")} || ' ms, total ' || {_num("n * 1006")} || ' ms, 2 pages, ' || {_num("n")} || ' nodes, depth ' || depth || ', source ' || {_num("p")} || ' pts / ' || {_dec("b / 1048576.0", 1)} || ' MiB' AS line FROM g""")
def fn_28(spark, d):
    n, p = F.col("n"), F.col("p")
    return _by_depth(spark, d).select("depth", status.diagnostics(n, n * 2, n * 3, n * 1000, n * 1006, F.lit(2), n, F.col("depth"), p, F.col("b")).alias("line"))


@query("fn_28_detail_progress", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Not streamed yet' ELSE {_num("event_id")} || ' / ' || {_num("event_id * 3")} || ' current-view nodes (' || {_dec("event_id % 97 / CAST(97 AS DOUBLE) * 100", 1)} || '% coverage' || CASE WHEN event_id % 3 = 0 THEN ', ' || {_dec("(1 + event_id % 97) / CAST(97 AS DOUBLE) * 100", 1)} || '% weighted' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ', render budget reached' ELSE '' END || ')' END AS line FROM events""")
def fn_28_detail(spark, d):
    i = F.col("event_id")
    final, coverage = F.when(i % 5 != 0, i * 3), i % 97 / 97
    return table(spark, d, "events").select(i, status.detail_progress(i, final, coverage, F.when(i % 3 == 0, (i % 97 + 1) / 97).otherwise(coverage), i % 2 == 0).alias("line"))


@query("fn_28_lod_summary", f"""SELECT event_id, 'Detail' || ', camera ' || {_dec("event_id / 4.0", 1)} || ' m, depth <= ' || (event_id % 9) || ', tile target 80 px, point spacing 2.25 px, source budget ' || {_cap("event_id * 100", "900000", "source pts")} || ' / ' || {_cap("900000", "900000", "per-node source pts")} || ', up to 1,024 nodes' AS line FROM events""")
def fn_28_lod(spark, d):
    i = F.col("event_id")
    most = F.lit(900_000)
    budgets = [status.budget(i * 100, most, "source pts"), status.budget(most, most, "per-node source pts")]
    return table(spark, d, "events").select(i, status.lod_summary(F.lit("Detail"), i / 4, i % 9, F.lit(80), F.lit(2.25), F.lit(1024), budgets).alias("line"))


@query("fn_28_selection", f"""SELECT event_id, {_num("event_id")} || CASE event_id % 4 WHEN 0 THEN ' nearest' WHEN 1 THEN ' coverage' WHEN 2 THEN ' progressive coverage' ELSE ' mixed-depth coverage' END || ' nodes at ' || CASE WHEN event_id % 3 = 0 THEN 'depth 2' ELSE 'depths ' || (2 - event_id % 3) || '-2' END || ' (target depth 3, selected depth ' || {_num("event_id % 900")} || ' px / 80 px target, root 2,000 px' || CASE WHEN event_id % 2 = 0 THEN ', spacing ' || {_dec("event_id / 8.0", 1)} || ' px / 3.5 px target' ELSE '' END || CASE WHEN event_id % 5 > 0 THEN ', ' || (event_id % 5) || ' outside frustum' ELSE '' END || CASE WHEN event_id % 7 > 0 THEN ', ' || (event_id % 7) || ' outside view' ELSE '' END || CASE WHEN event_id % 11 > 0 THEN ', ' || (event_id % 11) || ' skipped by budget' ELSE '' END || ')' AS line FROM events""")
def fn_28_selection(spark, d):
    i = F.col("event_id")
    mode = F.get(F.array(*[F.lit(m) for m in status.MODES]), (i % 4).cast("int"))
    spacing = F.when(i % 2 == 0, i / 8)
    return table(spark, d, "events").select(i, status.selection(mode, i, 2 - i % 3, F.lit(2), F.lit(3), i % 900, F.lit(80), F.lit(2000), spacing, F.lit(3.5), i % 5, i % 7, i % 11).alias("line"))


@query("fn_28_pages_and_mix", f"""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN ' after loading ' || (event_id % 4) || ' hierarchy pages' ELSE '' END AS pages, CASE WHEN event_id % 3 > 0 THEN {_num("event_id")} || ' selected detail nodes for the current view' ELSE {_num("event_id * 2")} || ' coverage nodes for this zoom level' END AS mix FROM events""")
def fn_28_pages(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i, status.loaded_pages(i % 4).alias("pages"), status.final_node_mix(F.when(i % 3 > 0, i).otherwise(0), i * 2).alias("mix"))


@query("fn_28_budget_summary", f"""SELECT event_id, {_cap("event_id * 10", "360000", "render pts cap")} || CASE WHEN event_id % 2 = 0 THEN ' (720,000 configured max)' ELSE '' END || ' / ' || {_cap("event_id * 20", "900000", "source pts")} AS line FROM events""")
def fn_28_budget(spark, d):
    i = F.col("event_id")
    configured = F.when(i % 2 == 0, 720_000).otherwise(360_000)
    return table(spark, d, "events").select(i, status.budget_summary(i * 10, F.lit(360_000), configured, [status.budget(i * 20, F.lit(900_000), "source pts")]).alias("line"))


@query("fn_28_visual_quality", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'terminal-ready' ELSE 'refining' END || ', ' || {_num("event_id")} || ' / ' || {_num("event_id + 5")} || ' additive nodes, ' || {_num("event_id")} || ' / ' || {_num("event_id")} || ' frontier nodes, ' || CASE event_id % 3 WHEN 0 THEN 'no frontier' WHEN 1 THEN 'frontier depth 4' ELSE 'frontier depth 2-4' END || ', 5 missing, ' || (event_id % 6) || ' stale/unexpected, 0 frontier overlaps, ' || CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'hierarchy complete for view' ELSE 'hierarchy completeness unknown' END WHEN event_id % 4 = 1 THEN '1 pending hierarchy page' ELSE (event_id % 4) || ' pending hierarchy pages' END AS line FROM events""")
def fn_28_quality(spark, d):
    i = F.col("event_id")
    low = F.when(i % 3 == 1, 4).when(i % 3 == 2, 2)
    return table(spark, d, "events").select(i, status.visual_quality(i % 2 == 0, i, i + 5, i, i, low, F.lit(4), F.lit(5), i % 6, F.lit(0), i % 4, i % 8 == 0).alias("line"))


@query("fn_29_lambert_forward", P + f"SELECT point_id, round(({_RHO} * sin({_THETA}) + {_L.x0}) / {_L.unit}, 3) AS px, round(({_L.rho0!r} - {_RHO} * cos({_THETA}) + {_L.y0}) / {_L.unit}, 3) AS py FROM points")
def fn_29(spark, d):
    x, y = _L.forward(*lonlat())
    return points(spark, d).select("point_id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query("fn_30_transform_descriptor", f"SELECT id, CASE WHEN id = 1 THEN 'epsg:2992' WHEN id = 5 THEN 'geographic' ELSE 'projected' END AS kind FROM {_WKT_SQL}")
def fn_30(spark, d):
    box = [F.lit(v) for v in (-121.0, 44.0, -120.0, 45.0)]
    status = crs.crs_status(F.col("wkt"), *box)
    return _wkts(spark).select("id", F.when(status == "wkt", "projected").otherwise(status).alias("kind"))


@query("fn_31_geometry_batch", P + f""", c AS (SELECT node_key, ({_N84} + z) * cos(radians({LAT})) * cos(radians({LON})) AS ex, CAST({_ATTR} AS BIGINT) AS rgb FROM points LEFT JOIN {_PALETTE} ON cls = classification)
  SELECT node_key, CAST(count(*) AS BIGINT) AS n, round(min(ex), 4) AS min_ex, round(max(ex), 4) AS max_ex, CAST(sum(rgb) AS BIGINT) AS rgb_sum FROM c GROUP BY node_key""")
def fn_31(spark, d):
    """Positions and colours of a node in one projection, with the bounds of what is finite."""
    x, _, _ = geometry.ecef(*lonlat(), F.col("z"))
    rgb = color.attribute_color(*[F.col(n) for n in ("red", "green", "blue", "classification", "intensity")])
    p = points(spark, d).select("node_key", x.alias("ex"), rgb.cast("bigint").alias("rgb"))
    ok = F.when(geometry.finite(F.col("ex")), F.col("ex"))
    return p.groupBy("node_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(ok), 4).alias("min_ex"), F.round(F.max(ok), 4).alias("max_ex"), F.sum("rgb").alias("rgb_sum"))


@query("fn_32_backing_bytes", N + "SELECT CAST(sum(data_length) AS BIGINT) AS bytes FROM (SELECT DISTINCT data_offset, data_length FROM (SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE depth < 2))")
def fn_32(spark, d):
    n = nodes(spark, d)
    return n.unionAll(n.filter("depth < 2")).select("data_offset", "data_length").distinct().agg(F.sum("data_length").alias("bytes"))


@query("flt_1_renderable", N + "SELECT key FROM nodes WHERE data_length > 0 AND point_count > 0")
def flt_1(spark, d):
    return nodes(spark, d).filter("data_length > 0 and (point_count is null or point_count > 0)").select("key")


@query("flt_2_view_filter", N + f"SELECT CAST(count(*) FILTER (WHERE {_CONE}) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT {_CONE}) AS BIGINT) AS culled FROM {_CONE_FROM} WHERE depth BETWEEN 1 AND 3")
def flt_2(spark, d):
    seen = geometry.in_view_cone(*eye(), DIRECTION, COS_CONE)
    n = nodes(spark, d).filter("data_length > 0 and point_count > 0 and depth between 1 and 3")
    return n.agg(F.count_if(seen).alias("kept"), F.count_if(~seen).alias("culled"))


PLANES = [(1.0, 0.0, 0.0, -250.0), (0.0, 1.0, 0.0, -250.0), (-1.0, 0.0, 0.0, 900.0), (0.0, 0.0, -1.0, 800.0)]


@query("flt_3_frustum", N + """, s AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, (min_z + max_z) / 2 AS cz, sqrt(3 * pow((max_x - min_x) / 2, 2)) AS radius FROM nodes)
  SELECT key, CASE WHEN depth < 2 THEN 0 ELSE 1 END AS turn FROM s WHERE depth < 2 OR (cx - 250 >= -radius AND cy - 250 >= -radius AND 900 - cx >= -radius AND 800 - cz >= -radius)""")
def flt_3(spark, d):
    """Nodes outside the depth range stay unculled and come first."""
    centre = tuple((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz")
    half = (F.col("max_x") - F.col("min_x")) / 2
    inside = F.col("depth") >= 2
    n = nodes(spark, d).filter(~inside | geometry.frustum_passes(PLANES, centre, F.sqrt(3 * half * half)))
    return n.select("key", F.when(inside, 1).otherwise(0).alias("turn"))


@query("flt_4_pages_in_view", N + f", c AS (SELECT key, {_CONE} AS seen, min_x <= 500 AND max_x >= 500 AND min_y <= 500 AND max_y >= 500 AS covers FROM {_CONE_FROM} WHERE depth = 2) SELECT key, seen, covers FROM c WHERE seen OR covers")
def flt_4(spark, d):
    pages = nodes(spark, d).filter("depth = 2")
    tol = 500 * geometry.EPSILON * 16
    covers = (F.col("min_x") <= 500 + tol) & (F.col("max_x") >= 500 - tol) & (F.col("min_y") <= 500 + tol) & (F.col("max_y") >= 500 - tol)
    return pages.select("key", geometry.in_view_cone(*eye(), DIRECTION, COS_CONE).alias("seen"), covers.alias("covers")).filter("seen or covers")


@query("flt_5_budget_predicates", N + "SELECT key, point_count > 30 OR data_length > 1200 AS over_node, sum(point_count) OVER (ORDER BY depth, z, y, x) > 5000 AS over_total, false AS over_unlimited FROM nodes")
def flt_5(spark, d):
    from pyspark.sql import Window

    from stratacloud.plans.selection import over_budget

    w = Window.orderBy("depth", "z", "y", "x").rowsBetween(Window.unboundedPreceding, 0)
    n = nodes(spark, d).withColumn("running", F.sum("point_count").over(w))
    return n.select("key", (over_budget(F.col("point_count"), 30) | over_budget(F.col("data_length"), 1200)).alias("over_node"), over_budget(F.col("running"), 5000).alias("over_total"), over_budget(F.col("running"), None).alias("over_unlimited"))


@query("flt_6_deepest_antichain", N + "SELECT n.key FROM nodes n WHERE n.depth < 3 AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth < 3 AND c.depth > n.depth AND c.x >> (c.depth - n.depth) = n.x AND c.y >> (c.depth - n.depth) = n.y AND c.z >> (c.depth - n.depth) = n.z)")
def flt_6(spark, d):
    from stratacloud.operators.tree import deepest_antichain

    return deepest_antichain(nodes(spark, d).filter("depth < 3").select("key"))


@query("flt_7_zoom_refinement", """WITH s AS (SELECT event_id, 10 * value AS h, lag(10 * value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT event_id, before IS NOT NULL AND (coalesce(h < before * 0.9, false) OR coalesce((CASE WHEN h <= 350 THEN 1.5 WHEN h <= 700 THEN 2.25 WHEN h <= 1500 THEN 3.5 WHEN h <= 3000 THEN 4 ELSE 4 END) < (CASE WHEN before <= 350 THEN 1.5 WHEN before <= 700 THEN 2.25 WHEN before <= 1500 THEN 3.5 ELSE 4 END), false)) AS refines FROM s""")
def flt_7(spark, d):
    from pyspark.sql import Window

    from stratacloud.plans.settings import lod_target_spacing, zooms_in

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("h", F.col("value") * 10).withColumn("before", F.lag(F.col("value") * 10).over(w))
    return e.select("event_id", zooms_in(F.col("before"), F.col("h"), lod_target_spacing(F.col("before")), lod_target_spacing(F.col("h"))).alias("refines"))


@query("flt_8_node_options", N + ", f AS (SELECT key, row_number() OVER (ORDER BY (key = '2-1-1-1') DESC, depth, z, y, x) AS pos FROM nodes WHERE contains(lower(key), '1-1') OR key = '2-1-1-1') SELECT key, pos FROM f WHERE pos <= 20")
def flt_8(spark, d):
    from pyspark.sql import Window

    n = nodes(spark, d).filter(F.lower("key").contains("1-1") | (F.col("key") == "2-1-1-1"))
    order = [(F.col("key") == "2-1-1-1").desc(), "depth", "z", "y", "x"]
    top = n.orderBy(*order).limit(20)
    return top.select("key", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("pos"))
