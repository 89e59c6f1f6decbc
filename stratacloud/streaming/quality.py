"""What a frame has reached: stages, completion, the gate for swapping it in, and the proof that it is final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.operators.sets import render_errors
from stratacloud.operators.tree import deepest_antichain, missing_ancestors

# Shares that the swap gate asks for.
SWAP_COVERAGE, SWAP_POINTS = 0.65, 0.6


def stage(rendered: Column, final: Column, coverage: Column, exact: Column) -> Column:
    """preview, refining, interactive-ready or terminal."""
    return F.when(exact & (rendered >= final), "terminal").when(coverage >= SWAP_COVERAGE, "interactive-ready").when(rendered > 0, "refining").otherwise("preview")


def completed(rendered: Column, final: Column, node_floor: float, budget_fill: Column, fill_floor: float, weighted: Column | None = None, weighted_floor: float = 1.0, full: bool = False, any_point: Column | None = None) -> Column:
    """Whether detail may stop: all nodes, or enough by weight, by budget or by count."""
    share = rendered / F.greatest(final, F.lit(1))
    every = rendered >= final
    nodes = share >= node_floor
    heavy = F.lit(True) if weighted is None else F.coalesce(weighted >= weighted_floor, F.lit(True))
    by_weight = F.lit(False) if weighted is None else F.coalesce(weighted >= weighted_floor, F.lit(False)) & nodes
    enough = F.lit(False) if full else by_weight | ((budget_fill >= fill_floor) & nodes & heavy) | (nodes & heavy)
    return F.when(final == 0, F.coalesce(any_point, rendered > 0) if any_point is not None else rendered > 0).otherwise(every | enough)


def swap_gate(frames: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``retained`` (the most points so far) and ``swaps``: enough covered, and enough points beside what is kept."""
    before = F.coalesce(F.max("points").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = frames.withColumn("retained", before)
    floor_ = F.ceil(F.least(F.col("retained"), F.col("budget")) * SWAP_POINTS)
    return f.withColumn("swaps", (F.col("coverage") >= SWAP_COVERAGE) & (F.col("points") >= floor_))


def proof(required: DataFrame, rendered: DataFrame, nodes: DataFrame, pending: int = 0) -> DataFrame:
    """One row: antichain, closure and exactness of a frame, and whether it is final."""
    errors = render_errors(required, rendered.select("key"))
    counts = errors.agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "unexpected").alias("unexpected"))
    leaf = deepest_antichain(required.select("key"))
    holes = missing_ancestors(leaf, nodes).agg(F.count(F.lit(1)).alias("holes"))
    chain = leaf.agg(F.count(F.lit(1)).alias("frontier"))
    final = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("holes") == 0) & F.lit(pending == 0)
    return counts.crossJoin(holes).crossJoin(chain).select("missing", "unexpected", "holes", "frontier", final.alias("final"))
