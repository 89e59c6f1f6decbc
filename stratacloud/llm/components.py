"""Connected components of an edge table by alternating large-star and small-star rounds.

All state stays distributed: each round is two aggregations and joins over as many partitions as the number of edges asks
for, its edges are written to the shared folder, and only one row (number and checksum of the edges) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, light_partitions


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, in any number. Large: link u's larger neighbours to its least; small: its smaller ones and itself."""
    around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    linked = around.join(least, F.col("u") == F.col("k"))
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v")


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(a, b) pairs of ids to (id, component_id): every id that has an edge, with the least id it reaches.

    Null ids, loops, repeated and reversed edges are harmless; no edges give no rows. ``most`` is a number of edges that
    the caller expects at most; it sizes the first shuffle.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = scratch.save(now, "edges", partitions=light_partitions(most) if most is not None else None), None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
        new = scratch.save(_star(_star(now, True), False).distinct(), "edges", partitions=light_partitions(mark[0]))
        scratch.drop(now)
        now, before = new, mark
    raise RuntimeError(f"components did not settle within {rounds} rounds")
