"""Orders in which nodes are asked for, coverage and preview keys, prefetch, and the signature of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.geometry import half_up
from stratacloud.functions.keys import ancestor_keys, key_depth


def spatial_bucket(key: Column) -> Column:
    """The ancestor at depth 2, or the key itself above that."""
    up = ancestor_keys(key)
    return F.coalesce(F.get(up, F.lit(2)), key)


def progressive_coverage(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(pos, key) with ``place``: by turns from the buckets in the order of their names; in a bucket as they came."""
    by = by or []
    k = keys.withColumn("bucket", spatial_bucket(F.col("key")))
    k = k.withColumn("round", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("pos")))
    return k.withColumn("place", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy("round", "bucket")) - 1).drop("bucket", "round")


def additive_progress(keys: DataFrame) -> DataFrame:
    """Distinct keys by depth, each depth in its progressive coverage."""
    once = keys.groupBy("key").agg(F.min("pos").alias("pos")).withColumn("level", key_depth(F.col("key")))
    inside = progressive_coverage(once, ["level"])
    return inside.withColumn("place", F.row_number().over(Window.orderBy("level", "place")) - 1).drop("level")


def distributed_picks(keys: DataFrame, count: int) -> DataFrame:
    """(pick, key): ``count`` keys spread evenly over the list, or all."""
    numbered = keys.withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    m = F.least(F.lit(count), F.col("n"))
    turns = numbered.filter("i = 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1)).alias("pick"), "n", m.alias("m"))
    at = turns.select("pick", F.when(F.col("m") <= 1, F.lit(0)).otherwise(half_up(F.col("pick") * (F.col("n") - 1) / (F.col("m") - 1))).alias("i"))
    return at.join(numbered, "i").select("pick", "key")


def request_priorities(nodes: DataFrame, base: float) -> DataFrame:
    """Adds ``priority``: earlier nodes first, lighter ones a little before heavier ones."""
    every = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(every)
    rank = F.row_number().over(Window.orderBy("pos")) - 1
    lead = F.when(n > 1, 0.9 * (n - 1 - rank) / (n - 1)).otherwise(0.9)
    return nodes.withColumn("priority", base + lead + 0.01 * (1 - F.col("weight") / F.max("weight").over(every)))


def points_per_node(configured: Column, budget: Column, nodes: Column, headroom: bool = False) -> Column:
    """The configured cap, or an even share of the budget if that is less."""
    return configured if headroom else F.least(configured, F.ceil(budget / F.greatest(nodes, F.lit(1))))


def coverage_keys(nodes: DataFrame, selected_depth: int, deep: bool = False) -> DataFrame:
    """Shallow nodes that cover the view before detail comes."""
    top = min(max(selected_depth - (3 if deep else 2), 0), 2)
    return nodes.filter(F.col("depth") <= top)


def preview_keys(keys: DataFrame, count: int, most_bytes: int) -> DataFrame:
    """Spread picks while their bytes fit; the first comes even if it is too large."""
    picks = distributed_picks(keys.select("pos", "key"), count).join(keys.select("key", "data_length"), "key")
    rows = F.array_sort(F.collect_list(F.struct("pick", "key", "data_length")))
    state = F.struct(F.array().cast("array<string>").alias("keys"), F.lit(0).cast("bigint").alias("bytes"))

    def step(s: Column, r: Column) -> Column:
        fits = (F.size(s["keys"]) == 0) | (s["bytes"] + r["data_length"] <= most_bytes)
        return F.when(fits, F.struct(F.concat(s["keys"], F.array(r["key"])).alias("keys"), (s["bytes"] + r["data_length"]).alias("bytes"))).otherwise(s)

    return picks.agg(rows.alias("rows")).select(F.posexplode(F.aggregate("rows", state, step)["keys"]).alias("pos", "key"))


def prefetch_keys(nodes: DataFrame, sampled: DataFrame, priority: DataFrame, count: int) -> DataFrame:
    """Nodes without a fresh sample: those with priority first, then the heaviest."""
    rest = nodes.join(sampled.select("key"), "key", "left_anti").join(priority.select("key", F.lit(1).alias("first")), "key", "left")
    return rest.orderBy(F.coalesce("first", F.lit(0)).desc(), F.col("point_count").desc(), "key").limit(count).select("key")


def signature(keys: DataFrame) -> DataFrame:
    """One string that tells two sets of keys apart."""
    return keys.agg(F.array_join(F.array_sort(F.collect_set("key")), "|").alias("signature"))
