"""Nested samples of nodes: every sample is a prefix of the node's progressive order, so a denser one answers a sparser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.morton import progressive_order


def ranked(points: DataFrame) -> DataFrame:
    return progressive_order(points, "node_key", "point_id")


def prefix(points: DataFrame, count: int) -> DataFrame:
    """The first ``count`` points of each node."""
    return ranked(points).filter(F.col("prog_rank") < count)


def node_budgets(nodes: DataFrame, total: int, per_node: int) -> DataFrame:
    """(key, budget): even shares of a total, the first nodes in catalog order one more, none above ``per_node``."""
    order = Window.orderBy("depth", "z", "y", "x")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    share = F.floor(F.lit(total) / n) + F.when(F.row_number().over(order) <= F.lit(total) % n, 1).otherwise(0)
    return nodes.select("key", F.least(share, F.lit(per_node), F.col("point_count")).cast("bigint").alias("budget"))


def sample(points: DataFrame, budgets: DataFrame) -> DataFrame:
    """Points of the nodes that have a budget, each node to its own. The catalog side is small and bounded by the view."""
    return ranked(points.join(budgets.withColumnRenamed("key", "node_key"), "node_key")).filter("prog_rank < budget")


def densest(samples: DataFrame) -> DataFrame:
    """Of several samples of a node (key, sampled, turn) the densest; of equal ones the first."""
    best = Window.partitionBy("key").orderBy(F.col("sampled").desc(), "turn")
    return samples.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


CHANNELS = ("x", "y", "z", "red", "green", "blue", "classification", "intensity")


def to_channels(points: DataFrame) -> DataFrame:
    """One row per node with an array per channel. A channel that no point has is null as a whole."""
    row = F.sort_array(F.collect_list(F.struct("point_id", *CHANNELS)))
    packed = points.groupBy("node_key").agg(row.alias("rows"))
    column = lambda c: F.when(F.exists("rows", lambda r: r[c].isNotNull()), F.transform("rows", lambda r: r[c]))
    return packed.select("node_key", F.transform("rows", lambda r: r["point_id"]).alias("point_id"), *[column(c).alias(c) for c in CHANNELS])


def to_rows(channels: DataFrame) -> DataFrame:
    """Back to points: missing colours become cyan, missing classes and intensities 0."""
    at = F.posexplode("point_id").alias("i", "id")
    out = channels.select("node_key", *CHANNELS, at)
    fallback = {"red": 0, "green": 255, "blue": 255, "classification": 0, "intensity": 0}
    get = lambda c: F.get(F.col(c), F.col("i"))
    return out.select("node_key", F.col("id").alias("point_id"), *[(F.coalesce(get(c), F.lit(fallback[c])) if c in fallback else get(c)).alias(c) for c in CHANNELS])


def pack_batches(points: DataFrame) -> DataFrame:
    """(node_key, positions, colors): three floats and four bytes (alpha 255) per point, in the order of points."""
    from stratacloud.functions.color import attribute_color, unpack_rgb

    rgb = attribute_color(*[F.col(c) for c in ("red", "green", "blue", "classification", "intensity")])
    row = points.withColumn("rgb", rgb).select("node_key", F.struct("point_id", "x", "y", "z", "rgb").alias("p"))
    rows = F.array_sort(F.collect_list("p"))
    return row.groupBy("node_key").agg(rows.alias("rows")).select(
        "node_key",
        F.flatten(F.transform("rows", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("positions"),
        F.flatten(F.transform("rows", lambda r: F.array(*unpack_rgb(r["rgb"]), F.lit(255)))).alias("colors"),
    )
