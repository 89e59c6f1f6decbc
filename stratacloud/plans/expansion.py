"""Iterative catalog expansion: each round loads the nearest pending pages that earlier rounds have revealed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.geometry import box_distance
from stratacloud.functions.keys import parent_key


def nearest_pages(pages: DataFrame, target: tuple[float, float], count: int) -> DataFrame:
    """The pages nearest to a place on the map; ties to shallower ones, then by key."""
    return pages.withColumn("away", box_distance(F.lit(target[0]), F.lit(target[1]))).orderBy("away", "depth", "key").limit(count)


def page_batches(pages: DataFrame, budget: int, at_once: int = 2) -> DataFrame:
    """The first ``budget`` pages in catalog order with ``batch``, the turn in which each is loaded: ``at_once`` per turn."""
    order = ["depth", "z", "y", "x"]
    first = pages.orderBy(*order).limit(budget)
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / at_once))


def expand(nodes: DataFrame, target: tuple[float, float], first_depth: int, rounds: tuple[int, ...]) -> DataFrame:
    """(key) of the pages that are loaded, with a page budget per round. Pages of the next depth show once their parent is in."""
    loaded: list[DataFrame] = []
    pending = nodes.filter(F.col("depth") == first_depth)
    for k, count in enumerate(rounds):
        chosen = nearest_pages(pending, target, count).select("key")
        loaded.append(chosen)
        below = nodes.filter(F.col("depth") == first_depth + k + 1)
        pending = below.join(chosen.withColumnRenamed("key", "up"), parent_key(F.col("key")) == F.col("up")).drop("up")
    return reduce(DataFrame.unionByName, loaded)
