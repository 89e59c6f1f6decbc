"""Streaming and stateful operators (STR); the str_*_stream queries run Structured Streaming to the end of the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratacloud.fixtures import NODES_SQL, nodes, table
from stratacloud.plans import render_plan
from stratacloud.queries import query
from stratacloud.queries.planners import _CLOSED
from stratacloud.queries.trees import _KEYS, stream_keys
from stratacloud.streaming import budget, camera, quality

N = "WITH " + NODES_SQL
_NEWEST = "SELECT user_id, max(ts) AS ts, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id"
_DEBOUNCED = "WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) SELECT user_id, event_id, ts FROM e WHERE after IS NULL OR after - ts >= INTERVAL 30 MINUTE"


def events(spark, d):
    return table(spark, d, "events")


@query("str_1_newest_request", _NEWEST)
def str_1(spark, d):
    return camera.newest(events(spark, d)).select("user_id", "ts", "event_id")


@query("str_1_newest_request_stream", _NEWEST)
def str_1_stream(spark, d):
    return camera.run_to_end(camera.newest(camera.read_events(spark, d)), "complete").select("user_id", "ts", "event_id")


@query("str_2_debounce", _DEBOUNCED)
def str_2(spark, d):
    return camera.debounced(events(spark, d)).select("user_id", "event_id", "ts")


@query("str_2_debounce_stream", _DEBOUNCED)
def str_2_stream(spark, d):
    return camera.run_to_end(camera.debounced(camera.read_events(spark, d)), "complete").select("user_id", "event_id", "ts")


_FROM_MIDDLE = "sqrt(pow(greatest(min_x - 500, 500 - max_x, 0), 2) + pow(greatest(min_y - 500, 500 - max_y, 0), 2))"
_LOADED = NODES_SQL.replace("nodes AS (SELECT key, depth, x", "every_node AS (SELECT key, depth, x") + f""", q1 AS (SELECT * FROM every_node WHERE depth = 1 ORDER BY {_FROM_MIDDLE}, depth, key LIMIT 8),
 q2 AS (SELECT n.* FROM every_node n WHERE n.depth = 2 AND EXISTS (SELECT 1 FROM q1 WHERE n.x >> 1 = q1.x AND n.y >> 1 = q1.y AND n.z >> 1 = q1.z) ORDER BY {_FROM_MIDDLE}, depth, key LIMIT 64),
 nodes AS (SELECT * FROM every_node WHERE depth = 0 OR key IN (SELECT key FROM q1) OR key IN (SELECT key FROM q2))"""


@query("str_3_engine", "WITH " + _LOADED + _CLOSED + " SELECT key, depth FROM closed")
def str_3(spark, d):
    """Select over the loaded catalog, load pages, select again, close."""
    from stratacloud.api import PointCloud
    from stratacloud.plans.expansion import expand
    from stratacloud.queries.planners import CAMERA

    cloud = PointCloud.load(spark, d)
    pages = expand(cloud.nodes, (500.0, 500.0), 1, (8, 64))
    loaded = cloud.nodes.join(pages.unionByName(cloud.nodes.filter("depth = 0").select("key")), "key", "left_semi")
    return PointCloud(cloud.points, loaded).select(CAMERA).select("key", "depth")


@query("str_4_stages", "SELECT event_id, CASE WHEN event_id % 50 >= 48 AND event_id % 3 = 0 THEN 'terminal' WHEN value / 300 >= 0.65 THEN 'interactive-ready' WHEN event_id % 50 > 0 THEN 'refining' ELSE 'preview' END AS stage FROM events")
def str_4(spark, d):
    i = F.col("event_id")
    return events(spark, d).select("event_id", quality.stage(i % 50, F.lit(48), F.col("value") / 300, i % 3 == 0).alias("stage"))


@query("str_5_frame_proof", N + ", r AS (SELECT key FROM nodes WHERE depth <= 2), s AS (SELECT key FROM nodes WHERE (depth <= 2 AND x % 5 <> 1) OR (depth = 3 AND x = 7)) SELECT (SELECT CAST(count(*) AS BIGINT) FROM r ANTI JOIN s USING (key)) AS missing, (SELECT CAST(count(*) AS BIGINT) FROM s ANTI JOIN r USING (key)) AS unexpected, CAST(0 AS BIGINT) AS holes, (SELECT CAST(count(*) AS BIGINT) FROM nodes n WHERE depth <= 2 AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth <= 2 AND c.depth > n.depth AND c.x >> (c.depth - n.depth) = n.x AND c.y >> (c.depth - n.depth) = n.y AND c.z >> (c.depth - n.depth) = n.z)) AS frontier, false AS final")
def str_5(spark, d):
    n = nodes(spark, d)
    return quality.proof(n.filter("depth <= 2").select("key"), n.filter("(depth <= 2 and x % 5 <> 1) or (depth = 3 and x = 7)").select("key"), n)


@query("str_6_swap_gate", "WITH f AS (SELECT event_id, value / 300 AS coverage, CAST(floor(value * 1000) AS BIGINT) AS points, max(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) SELECT event_id, coalesce(high, 0) AS retained, coverage >= 0.65 AND points >= ceil(least(coalesce(high, 0), 200000) * 0.6) AS swaps FROM f")
def str_6(spark, d):
    f = events(spark, d).select("event_id", "user_id", "ts", (F.col("value") / 300).alias("coverage"), F.floor(F.col("value") * 1000).alias("points"), F.lit(200_000).alias("budget"))
    return quality.swap_gate(f, "user_id", ["ts", "event_id"]).select("event_id", "retained", "swaps")


@query("str_7_detail_completion", "SELECT event_id, CASE WHEN event_id % 20 = 0 THEN event_id % 30 > 0 ELSE event_id % 30 >= event_id % 20 OR ((event_id % 30) / CAST(event_id % 20 AS DOUBLE) >= 0.7 AND (event_id % 4 = 0 OR value / 300 >= 0.8)) END AS done FROM events")
def str_7(spark, d):
    i = F.col("event_id")
    weighted = F.when(i % 4 != 0, F.col("value") / 300)
    return events(spark, d).select("event_id", quality.completed(i % 30, i % 20, 0.7, F.col("value") / 400, 0.9, weighted, 0.8).alias("done"))


def runs(e):
    v = F.col("value")
    return e.select("user_id", "ts", "event_id", (v * 10).alias("render"), (v * 100).alias("total"), (v * 20).alias("decode"), (v * 25).alias("worker"), (v * 22).alias("trip"))


def _budget_sql() -> str:
    slow_r, slow_s = "v * 10 > 2500", "(v * 100 > 45000 OR v * 20 > 8000 OR v * 25 > 10000 OR v * 22 > 10000)"
    below = " OR ".join(f"s.{k} < {budget.LIMITS[k]}" for k in budget.BUDGETS)
    stable = f"(NOT ({slow_r}) AND NOT {slow_s} AND ({below}) AND v * 100 < 8000 AND v * 10 < 1500 AND v * 20 < 2500 AND v * 25 < 3500 AND v * 22 < 3500)"
    cols = []
    for k in budget.BUDGETS:
        hit, factor = (slow_r, budget.RENDER_CUT) if k == "rendered" else (slow_s, budget.SOURCE_CUT)
        cols.append(f"CAST(CASE WHEN {hit} THEN least(s.{k}, greatest({budget.LEAST[k]}, floor(s.{k} * {factor}))) WHEN {stable} AND s.streak + 1 >= 3 THEN least({budget.LIMITS[k]}, ceil(s.{k} * 1.25)) ELSE s.{k} END AS BIGINT)")
    first = ", ".join(f"CAST({budget.LIMITS[k]} AS BIGINT)" for k in budget.BUDGETS)
    names = ", ".join(budget.BUDGETS)
    return f"""WITH RECURSIVE o AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s(user_id, i, {names}, streak) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), {first}, CAST(0 AS BIGINT) FROM o UNION ALL SELECT s.user_id, o.i, {', '.join(cols)}, CAST(CASE WHEN {stable} AND s.streak + 1 < 3 THEN s.streak + 1 ELSE 0 END AS BIGINT) FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
 SELECT s.user_id, {', '.join('s.' + k for k in budget.BUDGETS)}, s.streak FROM s JOIN (SELECT user_id, max(i) AS i FROM o GROUP BY user_id) m ON m.user_id = s.user_id AND m.i = s.i"""


@query("str_8_adaptive_budget", _budget_sql())
def str_8(spark, d):
    return budget.fold(runs(events(spark, d)))


@query("str_8_adaptive_budget_stream", _budget_sql())
def str_8_stream(spark, d):
    """Keyed state over the stream; of the updates of a session the last is its state."""
    return camera.run_to_end(budget.stream(runs(camera.read_events(spark, d))), "update")


def _fresh(keys):
    """The samples of the nodes used last; fresh if as dense as they would be drawn."""
    s = keys.groupBy("key").agg(F.max("value").alias("sampled"), F.max("pos").alias("used"))
    kept = s.orderBy(F.col("used").desc()).limit(64)
    return kept.select("key", (F.col("sampled") >= F.least(F.lit(250), F.lit(200))).alias("fresh"))


@query("str_9_fresh_samples", f"WITH {_KEYS}, l AS (SELECT key, max(value) AS sampled, max(pos) AS used FROM keys GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY used DESC) AS k FROM l) SELECT key, sampled >= least(250, 200) AS fresh FROM r WHERE k <= 64")
def str_9(spark, d):
    return _fresh(stream_keys(spark, d))


@query("str_10_reuse", """WITH k AS (SELECT event_id, user_id, ts, event_id % 3 AS depth, CASE event_id % 3 WHEN 0 THEN 0 ELSE (event_id // 3) % 2 END AS x FROM events), b AS (SELECT *, lag(depth) OVER w AS bd, lag(x) OVER w AS bx FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, coalesce(CASE WHEN bd <= depth THEN x >> (depth - bd) = bx ELSE bx >> (bd - depth) = x END, false) AS reuses FROM b""")
def str_10(spark, d):
    i = F.col("event_id")
    x = F.when(i % 3 == 0, 0).otherwise(F.floor(i / 3) % 2)
    e = events(spark, d).select("event_id", "user_id", "ts", F.concat_ws("-", (i % 3).cast("string"), x.cast("string"), F.lit("0"), F.lit("0")).alias("key"))
    return camera.superseded(e).select("event_id", "reuses")


@query("str_12_progressive_batches", N + " SELECT batch, CAST(sum(sum(point_count)) OVER (ORDER BY batch) AS BIGINT) AS points FROM (SELECT point_count, (row_number() OVER (ORDER BY depth, z, y, x) - 1) // 64 AS batch FROM nodes) GROUP BY batch")
def str_12(spark, d):
    n = nodes(spark, d).withColumn("batch", F.floor((F.row_number().over(Window.orderBy("depth", "z", "y", "x")) - 1) / 64))
    per = n.groupBy("batch").agg(F.sum("point_count").alias("p"))
    return per.select("batch", F.sum("p").over(Window.orderBy("batch")).alias("points"))


@query("str_14_request_priority", "SELECT event_id, event_id * 10 + CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 3 WHEN 'signup' THEN 2 ELSE 0 END AS priority FROM events")
def str_14(spark, d):
    kind = F.when(F.col("event_type") == "view", "preview").when(F.col("event_type") == "click", "detail").when(F.col("event_type") == "signup", "warmup").otherwise("none")
    return events(spark, d).select("event_id", camera.request_priority(F.col("event_id"), kind).alias("priority"))


@query("str_15_followup_signature", N + " SELECT depth, string_agg(key, '|' ORDER BY key) AS signature FROM nodes GROUP BY depth")
def str_15(spark, d):
    n = nodes(spark, d)
    return n.groupBy("depth").agg(F.array_join(F.array_sort(F.collect_set("key")), "|").alias("signature"))


@query("str_15_seen_signatures_stream", "SELECT DISTINCT user_id, event_type FROM events")
def str_15_stream(spark, d):
    """A follow-up runs once per signature: repeats are dropped by keyed state."""
    return camera.run_to_end(camera.read_events(spark, d).select("user_id", "event_type").dropDuplicates(), "append")


@query("pln_10_signature", N + " SELECT string_agg(key, '|' ORDER BY key) AS signature FROM nodes WHERE depth <= 1")
def pln_10_signature(spark, d):
    return render_plan.signature(nodes(spark, d).filter("depth <= 1"))
