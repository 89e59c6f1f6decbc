"""Tree relations and set operations (JN, SET, and the overlap ratios)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.fixtures import NODES_SQL, nodes, table
from stratacloud.functions.keys import parent_key
from stratacloud.operators import sets, tree
from stratacloud.queries import query

N = "WITH " + NODES_SQL
_UNDER = "c.depth >= n.depth AND c.x >> (c.depth - n.depth) = n.x AND c.y >> (c.depth - n.depth) = n.y AND c.z >> (c.depth - n.depth) = n.z"
_VIEWS = ", views AS (SELECT key, (x + y + z) % 4 <> 0 AS visible, CASE WHEN y % 7 = 3 THEN NULL ELSE (x + z) % 5 <> 0 OR depth = 0 END AS ready FROM nodes WHERE (x * 31 + y * 17 + z) % 6 <> 0)"
#: Keys by camera events: places in order of time, keys from the value.
_KEYS = "keys AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS pos, (event_id % 4) || '-' || (event_id % (1 << (event_id % 4))) || '-' || ((event_id * 7) % (1 << (event_id % 4))) || '-' || ((event_id * 3) % (1 << (event_id % 4))) AS key, value FROM events)"


def views(n):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    ready = F.when(y % 7 == 3, None).otherwise(((x + z) % 5 != 0) | (F.col("depth") == 0))
    return n.filter((x * 31 + y * 17 + z) % 6 != 0).select("key", ((x + y + z) % 4 != 0).alias("visible"), ready.alias("ready"))


def stream_keys(spark, d):
    e = sets.places_in_time(table(spark, d, "events"), "ts", "event_id")
    i = F.col("event_id")
    size = F.pow(F.lit(2), i % 4).cast("bigint")
    key = F.concat_ws("-", *[c.cast("string") for c in (i % 4, i % size, (i * 7) % size, (i * 3) % size)])
    return e.select("pos", key.alias("key"), "value")


@query("jn_1_view_index", N + _VIEWS + " SELECT n.key, v.visible, v.ready FROM nodes n LEFT JOIN views v USING (key)")
def jn_1(spark, d):
    n = nodes(spark, d)
    v = views(n)
    once = v.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.first("visible").alias("visible"), F.first("ready").alias("ready"))
    checked = once.select("key", F.when(F.col("c") > 1, F.raise_error(F.concat(F.lit("key twice: "), "key"))).otherwise(F.col("visible")).cast("boolean").alias("visible"), "ready")
    return n.select("key").join(checked, "key", "left")


@query("jn_2_complete_paths", N + f" SELECT c.key, CAST(count(*) AS BIGINT) AS path_length FROM nodes c JOIN nodes n ON {_UNDER} GROUP BY c.key, c.depth HAVING count(*) = c.depth + 1")
def jn_2(spark, d):
    return tree.complete_paths(nodes(spark, d))


@query("jn_3_lenient_closure", N + f", f AS (SELECT * FROM nodes WHERE depth = 3 AND x >= 4 AND y < 3) SELECT DISTINCT n.key FROM nodes n JOIN f c ON {_UNDER}")
def jn_3(spark, d):
    n = nodes(spark, d)
    return tree.lenient_closure(n.filter("depth = 3 and x >= 4 and y < 3"), n).select("key")


@query("jn_3_strict_closure", N + f", f AS (SELECT * FROM nodes WHERE depth = 3 AND x >= 4 AND y < 3), p AS (SELECT c.key FROM nodes n JOIN f c ON {_UNDER} GROUP BY c.key, c.depth HAVING count(*) = c.depth + 1) SELECT DISTINCT n.key FROM nodes n JOIN f c ON {_UNDER} WHERE (SELECT count(*) FROM p) = (SELECT count(*) FROM f)")
def jn_3_strict(spark, d):
    n = nodes(spark, d)
    return tree.strict_closure(n.filter("depth = 3 and x >= 4 and y < 3"), n).select("key")


@query("jn_4_visible_children", N + _VIEWS + " SELECT (depth - 1) || '-' || (x >> 1) || '-' || (y >> 1) || '-' || (z >> 1) AS parent, array_to_string(list_sort(list(key)), ',') AS children FROM nodes JOIN views USING (key) WHERE visible AND depth > 0 GROUP BY 1")
def jn_4(spark, d):
    n = nodes(spark, d)
    return tree.visible_children(n, views(n)).select("parent", F.array_join("children", ",").alias("children"))


@query("jn_5_frontier", N + " SELECT key FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth = n.depth + 1 AND c.x >> 1 = n.x AND c.y >> 1 = n.y AND c.z >> 1 = n.z)")
def jn_5(spark, d):
    return tree.frontier_of(nodes(spark, d)).select("key")


@query("jn_6_renderable", N + _VIEWS + f" SELECT c.key FROM nodes c JOIN nodes n ON {_UNDER} LEFT JOIN views v ON v.key = n.key GROUP BY c.key, c.depth HAVING count(*) = c.depth + 1 AND bool_and(coalesce(v.ready, true))")
def jn_6(spark, d):
    n = nodes(spark, d)
    return tree.renderable(n, views(n)).select("key")


_PAIRED = "SELECT CAST(count(*) AS BIGINT) AS overlaps FROM (SELECT pos, CAST(split_part(key, '-', 1) AS INT) AS depth, CAST(split_part(key, '-', 2) AS INT) AS x, CAST(split_part(key, '-', 3) AS INT) AS y, CAST(split_part(key, '-', 4) AS INT) AS z FROM keys) n JOIN (SELECT pos, CAST(split_part(key, '-', 1) AS INT) AS depth, CAST(split_part(key, '-', 2) AS INT) AS x, CAST(split_part(key, '-', 3) AS INT) AS y, CAST(split_part(key, '-', 4) AS INT) AS z FROM keys) c ON c.pos <> n.pos AND " + _UNDER + " AND (c.depth > n.depth OR c.pos > n.pos)"


@query("jn_7_ancestor_overlaps", f"WITH {_KEYS} {_PAIRED}")
def jn_7(spark, d):
    return tree.ancestor_overlaps(stream_keys(spark, d))


@query("jn_8_required_nodes", N + " SELECT key, point_count FROM nodes WHERE key IN ('0-0-0-0', '1-0-0-0', '1-1-1-1')")
def jn_8(spark, d):
    """A key without a node is an error, not a missing row."""
    wanted = spark.createDataFrame([("0-0-0-0",), ("1-0-0-0",), ("1-1-1-1",)], "key string")
    found = wanted.join(nodes(spark, d).select("key", "point_count", F.lit(True).alias("have")), "key", "left")
    return found.select("key", F.when(F.col("have").isNull(), F.raise_error(F.concat(F.lit("no node "), "key"))).otherwise(F.col("point_count")).cast("bigint").alias("point_count"))


@query("jn_9_aligned_weights", N + " SELECT key, CAST(coalesce(CASE WHEN x % 2 = 0 THEN point_count END, 1) AS DOUBLE) AS weight FROM nodes")
def jn_9(spark, d):
    n = nodes(spark, d)
    w = n.filter("x % 2 = 0").select("key", F.col("point_count").cast("double").alias("w"))
    return n.select("key").join(w, "key", "left").select("key", F.coalesce("w", F.lit(1.0)).alias("weight"))


@query("set_1_first_occurrence", f"WITH {_KEYS} SELECT key, CAST(min(pos) AS BIGINT) AS pos FROM keys GROUP BY key")
def set_1(spark, d):
    return sets.first_occurrences(stream_keys(spark, d))


@query("set_2_last_occurrence", f"WITH {_KEYS} SELECT key, CAST(max(pos) AS BIGINT) AS pos FROM keys GROUP BY key")
def set_2(spark, d):
    return sets.last_occurrences(stream_keys(spark, d))


@query("set_3_union_once", N + " SELECT key, CASE WHEN depth <= 2 THEN 'coverage' ELSE 'detail' END AS part FROM nodes WHERE depth <= 2 OR (depth >= 2 AND x % 2 = 0)")
def set_3(spark, d):
    n = nodes(spark, d)
    return sets.union_once(n.filter("depth <= 2").select("key", F.lit("coverage").alias("part")), n.filter("depth >= 2 and x % 2 = 0").select("key", F.lit("detail").alias("part")))


def _densest(keys):
    from stratacloud.operators.sampling import densest

    s = keys.select("key", F.floor("value").alias("sampled"), F.col("pos").alias("turn"))
    return densest(s).select("key", "sampled")


@query("set_4_densest_sample", f"WITH {_KEYS} SELECT key, sampled FROM (SELECT key, CAST(floor(value) AS BIGINT) AS sampled, row_number() OVER (PARTITION BY key ORDER BY floor(value) DESC, pos) AS k FROM keys) WHERE k = 1")
def set_4(spark, d):
    return _densest(stream_keys(spark, d))


@query("set_5_frame_errors", N + " SELECT key, CASE WHEN depth = 3 AND x % 3 = 0 THEN 'unexpected' ELSE 'missing' END AS problem FROM nodes WHERE (depth <= 2 AND x % 5 = 1) OR (depth = 3 AND x % 3 = 0)")
def set_5(spark, d):
    n = nodes(spark, d)
    return sets.render_errors(n.filter("depth <= 2").select("key"), n.filter("(depth <= 2 and x % 5 <> 1) or (depth = 3 and x % 3 = 0)").select("key"))


@query("set_6_first_place_last_value", f"WITH {_KEYS} SELECT key, CAST(min(pos) AS BIGINT) AS pos, max_by(value, pos) AS value FROM keys GROUP BY key")
def set_6(spark, d):
    return sets.first_place_last_value(stream_keys(spark, d))


@query("agg_10_exact_overlap", N + " SELECT round(CAST(count(*) FILTER (WHERE depth <= 2) AS DOUBLE) / count(*), 6) AS ratio FROM nodes WHERE x % 2 = 0")
def agg_10(spark, d):
    n = nodes(spark, d)
    return tree.exact_overlap(n.filter("depth <= 2"), n.filter("x % 2 = 0")).select(F.round("ratio", 6).alias("ratio"))


@query("agg_10_family_overlap", N + f", b AS (SELECT * FROM nodes WHERE depth = 2 AND x = 1), a AS (SELECT * FROM nodes WHERE x % 2 = 0) SELECT round(CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b n WHERE {_UNDER}) OR EXISTS (SELECT 1 FROM b k WHERE k.depth >= c.depth AND k.x >> (k.depth - c.depth) = c.x AND k.y >> (k.depth - c.depth) = c.y AND k.z >> (k.depth - c.depth) = c.z)) AS DOUBLE) / count(*), 6) AS ratio FROM a c")
def agg_10_family(spark, d):
    n = nodes(spark, d)
    return tree.family_overlap(n.filter("depth = 2 and x = 1"), n.filter("x % 2 = 0")).select(F.round("ratio", 6).alias("ratio"))


@query("src_17_expand_page", N + " SELECT key, CASE WHEN depth <= 1 THEN 'root' ELSE '2-' || (x >> (depth - 2)) || '-' || (y >> (depth - 2)) || '-' || (z >> (depth - 2)) END AS page FROM nodes WHERE depth <= 1 OR (depth >= 2 AND (x >> (depth - 2)) = 1)")
def src_17(spark, d):
    """Pages are subtrees below depth 2; those with x = 1 are loaded and take the place of their pending rows."""
    from stratacloud.functions.keys import ancestor_keys

    n = nodes(spark, d)
    root = n.filter("depth <= 1").select("key", F.lit("root").alias("page"))
    pages = n.filter("depth >= 2").withColumn("page", F.get(ancestor_keys(F.col("key")), F.lit(2)))
    loaded = pages.select("page").distinct().filter(F.split("page", "-")[1] == "1")
    return root.unionByName(pages.join(loaded, "page", "left_semi").select("key", "page"))


@query("src_19_evictable_pages", N + ", p AS (SELECT key, depth, x, y, z FROM nodes WHERE depth BETWEEN 1 AND 2) SELECT key FROM p WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM p c WHERE c.depth = p.depth + 1 AND c.x >> 1 = p.x AND c.y >> 1 = p.y AND c.z >> 1 = p.z) ORDER BY x * 7 % 5, key LIMIT 10")
def src_19(spark, d):
    """Of loaded pages those without a loaded child, the longest unused first."""
    p = nodes(spark, d).filter("depth between 1 and 2")
    busy = p.select(parent_key(F.col("key")).alias("key")).distinct()
    return p.join(busy, "key", "left_anti").orderBy(F.col("x") * 7 % 5, "key").limit(10).select("key")
