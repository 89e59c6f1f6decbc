"""Ordered distinct, unions that keep the better row, and the differences that prove a frame complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places_in_time(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """The rows with pos, their place (from 1) in order of time and ties: counts per hour give each hour its first place."""
    rows = rows.withColumn("__hour", F.date_trunc("hour", time))
    earlier = Window.orderBy(F.col("__h").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("__hour").alias("__h")).agg(F.count(F.lit(1)).alias("__n")).select("__h", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__hour").orderBy(F.col(time).asc_nulls_last(), *ties)
    placed = rows.withColumn("__place", F.row_number().over(within)).join(starts, F.col("__hour").eqNullSafe(F.col("__h")))
    return placed.withColumn("pos", F.col("__start") + F.col("__place")).drop("__hour", "__h", "__place", "__start")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """(pos, key): each key once, at its first place; null and empty keys go."""
    return rows.filter("key is not null and key <> ''").groupBy("key").agg(F.min("pos").alias("pos"))


def last_occurrences(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max("pos").alias("pos"))


def first_place_last_value(rows: DataFrame) -> DataFrame:
    """(pos, key, value): the first place of each key with its last value."""
    return rows.groupBy("key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))


def union_once(*parts: DataFrame) -> DataFrame:
    """Rows of the parts in turn; a key that an earlier part holds is not repeated."""
    out = parts[0].withColumn("turn", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("turn", F.lit(i)))
    first = Window.partitionBy("key").orderBy("turn")
    return out.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k", "turn")


def render_errors(required: DataFrame, rendered: DataFrame) -> DataFrame:
    """(key, problem): keys missing from a frame, and keys that have no place in it."""
    missing = required.select("key").distinct().join(rendered, "key", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(rendered.select("key").distinct().join(required, "key", "left_anti").withColumn("problem", F.lit("unexpected")))
