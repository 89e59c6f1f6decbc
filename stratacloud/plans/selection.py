"""Level-of-detail selection for a camera over the node catalog.

Filters and estimates are columns; budgets that skip and go on are one sorted pass per depth; complete depths need sums only. The catalog is small beside the points, and points are read for the
chosen nodes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.geometry import box_distance, horizontal_span, in_view_cone, screen_pixels


@dataclass(frozen=True)
class Camera:
    """What is seen from where. Null budgets are no limits."""

    target: tuple[float, float, float]
    eye: tuple[float, float, float]
    viewport: float = 1080.0
    spacing: float = 1000.0 / 128
    node_pixels: float = 80.0
    spacing_pixels: float | None = 4.0
    min_depth: int = 0
    max_depth: int = 20
    max_nodes: int | None = 96
    max_points: int | None = None
    max_bytes: int | None = None
    max_node_points: int | None = None
    max_node_bytes: int | None = None
    direction: tuple[float, float, float] | None = None
    cone_cosine: float = 0.5


def over_budget(value: Column, budget: int | None) -> Column:
    return F.lit(False) if budget is None else value > budget


def candidates(nodes: DataFrame, camera: Camera) -> DataFrame:
    """Nodes with points in the depth range and the view, with ``distance`` (to the target) and ``eye_distance``."""
    t, e = [F.lit(v) for v in camera.target], [F.lit(v) for v in camera.eye]
    n = nodes.filter("data_length > 0 and point_count > 0").filter(F.col("depth").between(camera.min_depth, camera.max_depth))
    if camera.direction:
        n = n.filter(in_view_cone(*t, camera.direction, camera.cone_cosine))
    return n.withColumn("distance", box_distance(*t)).withColumn("eye_distance", box_distance(*e))


def depth_estimates(found: DataFrame, camera: Camera) -> DataFrame:
    """(depth, n, nearest, node_px, spacing_px): per depth its nearest node's size on screen."""
    px = screen_pixels(horizontal_span(), F.col("eye_distance"), camera.viewport)
    spx = screen_pixels(camera.spacing / F.pow(F.lit(2.0), F.col("depth")), F.col("eye_distance"), camera.viewport)
    near = F.min_by(F.struct("key", px.alias("node_px"), spx.alias("spacing_px")), F.struct("distance", -F.col("point_count"), "key"))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), near.alias("near")).select("depth", "n", F.col("near.key").alias("nearest"), "near.node_px", "near.spacing_px")


def target_depth(estimates: DataFrame, camera: Camera) -> DataFrame:
    """(target): the shallowest depth that is fine enough, else the deepest."""
    fine = F.col("node_px") <= camera.node_pixels
    if camera.spacing_pixels is not None:
        fine = fine & (F.col("spacing_px") <= camera.spacing_pixels)
    return estimates.agg(F.coalesce(F.min(F.when(fine, F.col("depth"))), F.max("depth")).alias("target"))


def nearest_first(depth: Column, target: Column) -> list[Column]:
    """Depths by their distance to the target; of two the deeper."""
    return [F.abs(depth - target), -depth]


def down_then_up(depth: Column, target: Column) -> list[Column]:
    """The target and shallower depths first, going up; then deeper ones, going down."""
    return [F.when(depth <= target, 0).otherwise(1), F.when(depth <= target, -depth).otherwise(depth)]


def _fitting(camera: Camera):
    """One pass over nodes that come sorted by group and order; held are the keys chosen so far, and nothing of what is skipped."""
    most = lambda budget: float("inf") if budget is None else budget
    nodes, points, bytes_, node_points, node_bytes = (most(b) for b in (camera.max_nodes, camera.max_points, camera.max_bytes, camera.max_node_points, camera.max_node_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, p, b, skipped = None, [], 0, 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([keys], pa.list_(pa.string())), pa.array([skipped], pa.int64())], names=["g", "chosen", "skipped"])
        for batch in batches:
            for g, key, own_p, own_b in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    if group is not None:
                        yield row()
                    group, keys, p, b, skipped = g, [], 0, 0, 0
                if len(keys) >= nodes:
                    continue
                if own_p > node_points or own_b > node_bytes or p + own_p > points or b + own_b > bytes_:
                    skipped += 1
                    continue
                keys.append(key)
                p, b = p + own_p, b + own_b
        if group is not None:
            yield row()

    return run


def greedy(found: DataFrame, camera: Camera, order: list[Column], by: str) -> DataFrame:
    """Per group the nodes that fit one after the other; one that doesn't is skipped and the next is tried.

    Returns (by, chosen, skipped): keys in order, and how many were skipped before the last could be chosen.
    """
    rows = found.select(F.col(by).cast("bigint").alias("g"), "key", F.col("point_count").cast("bigint").alias("p"), F.col("data_length").cast("bigint").alias("b"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    ordered = rows.repartition("g").sortWithinPartitions("g", *[f"o{i}" for i in range(len(order))]).select("g", "key", "p", "b")
    picked = ordered.mapInArrow(_fitting(camera), "g bigint, chosen array<string>, skipped bigint")
    return picked.select(F.col("g").cast(found.schema[by].dataType).alias(by), "chosen", "skipped")


def select_nearest(found: DataFrame, camera: Camera, target: DataFrame) -> DataFrame:
    """(pos, key) of the first depth, nearest to the target depth, that gives any node within the budgets."""
    picks = greedy(found, camera, [F.col("distance"), -F.col("depth"), -F.col("point_count"), F.col("key")], "depth").filter(F.size("chosen") > 0)
    best = picks.crossJoin(F.broadcast(target)).orderBy(*nearest_first(F.col("depth"), F.col("target"))).limit(1)
    return best.select(F.posexplode("chosen").alias("pos", "key"))


def select_complete(found: DataFrame, camera: Camera, target: DataFrame) -> DataFrame:
    """(pos, key): a whole depth that fits, or nothing. A depth with fewer nodes than the next shallower one is sparse."""
    per = found.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("point_count").alias("p"), F.sum("data_length").alias("b"), F.max("point_count").alias("most_p"), F.max("data_length").alias("most_b")
    )
    shallower = F.coalesce(F.lag("n").over(Window.orderBy("depth")), F.lit(0))
    per = per.withColumn("sparse", (shallower > 0) & (F.col("n") < shallower)).crossJoin(F.broadcast(target))
    fits = ~F.col("sparse") & ~over_budget(F.col("n"), camera.max_nodes) & ~over_budget(F.col("p"), camera.max_points) & ~over_budget(F.col("b"), camera.max_bytes) & ~over_budget(F.col("most_p"), camera.max_node_points) & ~over_budget(F.col("most_b"), camera.max_node_bytes)
    best = per.filter(fits).orderBy(*down_then_up(F.col("depth"), F.col("target"))).limit(1).select(F.col("depth").alias("best"))
    chosen = found.join(F.broadcast(best), F.col("depth") == F.col("best"))
    order = Window.orderBy("distance", "x", "y", "z", "key")
    return chosen.select((F.row_number().over(order) - 1).alias("pos"), "key", "depth")


def spread_order(found: DataFrame, camera: Camera, by: str = "depth") -> DataFrame:
    """Adds ``place``: nodes by turns from a grid of cells, nearest cell first, where there are more than the budget allows."""
    cells = max(1, int(-(-((camera.max_nodes or 1) ** 0.5) // 1)))
    whole = Window.partitionBy(by)
    mid = lambda a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
    cell = lambda a: F.least(F.lit(cells - 1), F.floor((mid(a) - F.min(f"min_{a}").over(whole)) / F.greatest(F.max(f"max_{a}").over(whole) - F.min(f"min_{a}").over(whole), F.lit(2.0**-52)) * cells))
    f = found.withColumn("bucket", cell("x") * cells + cell("y"))
    near = F.min("distance").over(Window.partitionBy(by, "bucket"))
    order = ["distance", "x", "y", "z", "key"]
    f = f.withColumn("round", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))).withColumn("near", near)
    many = F.count(F.lit(1)).over(whole) > (camera.max_nodes or 1 << 60)
    place = F.when(many, F.row_number().over(whole.orderBy("round", "near", "bucket"))).otherwise(F.row_number().over(whole.orderBy(*order)))
    return f.withColumn("place", place)


def select_progressive(found: DataFrame, camera: Camera, target: DataFrame) -> DataFrame:
    """(part, pos, key): a complete depth, and spread nodes of deeper ones with what is left of the budgets."""
    base = select_complete(found, camera, target)
    used = found.join(base.select("key"), "key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("p"), F.coalesce(F.sum("data_length"), F.lit(0)).alias("b"), F.coalesce(F.max("depth"), F.lit(-1)).alias("d")).first()
    left = lambda budget, spent: None if budget is None else max(0, budget - spent)
    rest = Camera(**(camera.__dict__ | {"max_nodes": left(camera.max_nodes, used["n"]), "max_points": left(camera.max_points, used["p"]), "max_bytes": left(camera.max_bytes, used["b"])}))
    out = base.select(F.lit("coverage").alias("part"), F.col("pos").cast("bigint").alias("pos"), "key")
    if used["d"] < 0 or rest.max_nodes == 0:
        return out
    deeper = spread_order(found.filter(F.col("depth") > used["d"]), rest)
    picks = greedy(deeper, rest, [F.col("place")], "depth").filter(F.size("chosen") > 0).crossJoin(F.broadcast(target)).orderBy(*nearest_first(F.col("depth"), F.col("target"))).limit(1)
    return out.unionByName(picks.select(F.lit("detail").alias("part"), F.posexplode("chosen").alias("pos", "key")).withColumn("pos", F.col("pos").cast("bigint")))


def select_nodes(nodes: DataFrame, camera: Camera, mode: str = "complete") -> DataFrame:
    """(key) of the selection in one of the modes nearest, complete, progressive, mixed."""
    found = candidates(nodes, camera)
    if mode == "mixed":
        from stratacloud.plans.mixed_depth import select_mixed

        return select_mixed(nodes, camera).filter("planned").select("key")
    target = target_depth(depth_estimates(found, camera), camera)
    pick = {"nearest": select_nearest, "complete": select_complete, "progressive": select_progressive}[mode]
    return pick(found, camera, target).select("key")
