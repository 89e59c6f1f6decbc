"""Dividing a global point budget among nodes, in closed form: sorted limits and prefix sums.

Fair shares fill all entries to one level. Sorted by limit, the entries before row i are full if the level that the rest
of the budget then gives to the others lies below the limit of row i; the first such row sets the level, and what is left
over goes one by one to the first entries above it. Weighted shares are the same with a level per unit of weight, and
give the rest by largest fraction. Everything is a window over one request's entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UP = (Window.unboundedPreceding, -1)


def _levels(entries: DataFrame, group: list[str], limit: Column, weight: Column, budget: Column) -> DataFrame:
    """Adds ``level`` and ``wide``: budget and weights that the first entry not filled, and all after it, share; null if all are full."""
    order = Window.partitionBy(*group).orderBy(limit / weight, "pos")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(*_UP)), F.lit(0))
    left = F.greatest(budget - before(limit), F.lit(0))
    wide = F.sum(weight).over(Window.partitionBy(*group)) - before(weight)
    x = entries.withColumn("left", left).withColumn("wide", wide).withColumn("turn", F.row_number().over(order))
    unfilled = F.when(limit > F.col("left") * weight / F.col("wide"), F.struct("turn", "left", "wide"))
    first = F.min(unfilled).over(Window.partitionBy(*group))
    return x.withColumn("first", first)


def fair_shares(entries: DataFrame) -> DataFrame:
    """(request, pos, cap, priority, budget) and ``allocated``: entries with priority share first. A null budget is no limit."""
    everyone, group = Window.partitionBy("request"), ["request", "priority"]
    urgent = F.coalesce(F.sum(F.when(F.col("priority"), F.col("cap"))).over(everyone), F.lit(0))
    own = F.when(F.col("priority"), F.col("budget")).otherwise(F.greatest(F.col("budget") - urgent, F.lit(0)))
    x = _levels(entries.withColumn("own", own), group, F.col("cap"), F.lit(1), F.col("own"))
    x = x.withColumn("filled", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("first.left") / F.col("first.wide")))))
    rest = F.col("own") - F.sum("filled").over(Window.partitionBy(*group))
    open_ = F.col("cap") > F.col("filled")
    nth = F.sum(open_.cast("bigint")).over(Window.partitionBy(*group).orderBy("pos"))
    x = x.withColumn("more", F.when(open_ & (nth <= rest), 1).otherwise(0))
    allocated = F.when(F.col("budget").isNull(), F.col("cap")).otherwise(F.col("filled") + F.col("more"))
    return x.withColumn("allocated", allocated.cast("bigint")).drop("own", "left", "wide", "turn", "first", "filled", "more")


def weighted_shares(entries: DataFrame) -> DataFrame:
    """(request, pos, cap, weight, budget) and ``allocated``; a weight that is not above 0 is an error."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("every entry needs a positive weight")).cast("double"))
    x = _levels(entries.withColumn("weight", weight), ["request"], F.col("cap"), F.col("weight"), F.col("budget"))
    quota = F.col("first.left") * F.col("weight") / F.col("first.wide")
    full = F.col("first").isNull() | (F.col("turn") < F.col("first.turn"))
    x = x.withColumn("full", full).withColumn("quota", quota)
    x = x.withColumn("filled", F.when(F.col("full"), F.col("cap")).otherwise(F.floor("quota"))).withColumn("part", F.when(~F.col("full"), F.col("quota") - F.floor("quota")))
    rest = F.col("budget") - F.sum("filled").over(Window.partitionBy("request"))
    nth = F.row_number().over(Window.partitionBy("request").orderBy(F.col("part").desc_nulls_last(), "pos"))
    x = x.withColumn("more", F.when(~F.col("full") & (nth <= rest), 1).otherwise(0))
    return x.withColumn("allocated", (F.col("filled") + F.col("more")).cast("bigint")).drop("left", "wide", "turn", "first", "full", "quota", "filled", "part", "more")


def allocate(entries: DataFrame, budget: int | None, per_node: int, weighted: bool) -> DataFrame:
    """(request, pos, points, weight, priority) to (request, pos, allocated); null weights count as 1, null priorities as none."""
    x = entries.select("request", "pos", F.least(F.greatest("points", F.lit(0)), F.lit(per_node)).cast("bigint").alias("cap"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("priority", F.lit(False)).alias("priority"), F.lit(budget).cast("bigint").alias("budget"))
    return (weighted_shares(x) if weighted else fair_shares(x)).select("request", "pos", "allocated")
