"""The octree as a relation: ancestors, closures, frontiers, antichains, readiness and overlaps.

All tree relations are equi-joins over exploded ancestor keys; none compares pairs of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.keys import ancestor_keys, parent_key


def ancestors(keys: DataFrame, key: str = "key", proper: bool = False) -> DataFrame:
    """(key, ancestor): every key with its ancestors, itself among them unless ``proper``."""
    out = keys.select(F.col(key).alias("key")).select("key", F.explode(ancestor_keys(F.col("key"))).alias("ancestor"))
    return out.filter("ancestor <> key") if proper else out


def lenient_closure(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the frontier and their ancestors; ancestors without a node are skipped."""
    wanted = ancestors(frontier).select(F.col("ancestor").alias("key")).distinct()
    return nodes.join(wanted, "key", "left_semi")


def missing_ancestors(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key): ancestors that have no node."""
    return ancestors(frontier).select(F.col("ancestor").alias("key")).distinct().join(nodes.select("key"), "key", "left_anti")


def strict_closure(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """As the lenient closure, but no rows at all if any ancestor is missing."""
    hole = missing_ancestors(frontier, nodes).agg(F.count(F.lit(1)).alias("holes"))
    return lenient_closure(frontier, nodes).crossJoin(F.broadcast(hole)).filter("holes = 0").drop("holes")


def complete_paths(nodes: DataFrame) -> DataFrame:
    """(key, path_length): nodes whose every ancestor has a node."""
    found = ancestors(nodes).join(nodes.select(F.col("key").alias("ancestor")), "ancestor").groupBy("key").agg(F.count(F.lit(1)).alias("path_length"))
    return found.join(nodes.select("key", "depth"), "key").filter(F.col("path_length") == F.col("depth") + 1).select("key", "path_length")


def first_missing(nodes: DataFrame) -> DataFrame:
    """(key, missing): per node the ancestor nearest the root that has no node."""
    gaps = ancestors(nodes).join(nodes.select(F.col("key").alias("ancestor")), "ancestor", "left_anti")
    return gaps.groupBy("key").agg(F.min_by("ancestor", F.split("ancestor", "-")[0].cast("int")).alias("missing"))


def frontier_of(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent in the set."""
    parents = nodes.select(parent_key(F.col("key")).alias("key")).filter("key is not null").distinct()
    return nodes.join(parents, "key", "left_anti")


def deepest_antichain(keys: DataFrame) -> DataFrame:
    """Keys without a descendant in the set."""
    return keys.join(ancestors(keys, proper=True).select(F.col("ancestor").alias("key")).distinct(), "key", "left_anti")


def renderable(nodes: DataFrame, ready: DataFrame) -> DataFrame:
    """Nodes whose whole path to the root is ready. ready: (key, ready); no row and null count as ready."""
    state = ready.select(F.col("key").alias("ancestor"), "ready")
    present = nodes.select(F.col("key").alias("ancestor"), F.lit(True).alias("present"))
    path = ancestors(nodes).join(present, "ancestor", "left").join(state, "ancestor", "left")
    good = path.groupBy("key").agg(F.min(F.coalesce("present", F.lit(False)) & F.coalesce("ready", F.lit(True))).alias("ok")).filter("ok")
    return nodes.join(good, "key", "left_semi")


def visible_children(nodes: DataFrame, views: DataFrame) -> DataFrame:
    """(parent, children): sorted keys of visible children with points."""
    seen = nodes.filter("data_length > 0 and point_count > 0").join(views.filter("visible").select("key"), "key", "left_semi")
    return seen.filter("depth > 0").groupBy(parent_key(F.col("key")).alias("parent")).agg(F.array_sort(F.collect_list("key")).alias("children"))


def ancestor_overlaps(keys: DataFrame) -> DataFrame:
    """(overlaps): unordered pairs of places (pos, key) of which one is the other's ancestor, or equal; from counts per key."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    up = counts.select("key", "n", F.explode(ancestor_keys(F.col("key"))).alias("ancestor"))
    other = counts.select(F.col("key").alias("ancestor"), F.col("n").alias("above"))
    pairs = F.when(F.col("key") == F.col("ancestor"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("above"))
    return up.join(other, "ancestor").agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("bigint").alias("overlaps"))


def exact_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ratio): share of the later keys that the earlier hold."""
    hit = after.join(before.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    return hit.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), F.lit(0.0)).alias("ratio"))


def family_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ratio): share of the later keys that are equal to, above or below an earlier one."""
    above = ancestors(before).select(F.col("ancestor").alias("key"))
    below = ancestors(after).join(before.select(F.col("key").alias("ancestor")), "ancestor", "left_semi").select("key")
    related = above.unionAll(below).distinct().withColumn("hit", F.lit(1))
    return after.join(related, "key", "left").agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), F.lit(0.0)).alias("ratio"))
