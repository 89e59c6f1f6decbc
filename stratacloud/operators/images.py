"""Masks as pixel tables: coverage, neighbours, square morphology, support; and small geometry of the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masks(points: DataFrame, width: int, height: int, rules: dict[str, Column], extent: float = 1000.0) -> DataFrame:
    """(px, py, a boolean per rule) for every pixel of the image: whether a point that fits the rule falls on it."""
    spark = points.sparkSession
    px = F.floor(F.col("x") / extent * (width - 0.001))
    py = F.floor(F.col("y") / extent * (height - 0.001))
    hits = points.select(px.alias("px"), py.alias("py"), *[r.alias(n) for n, r in rules.items()]).groupBy("px", "py").agg(*[F.bool_or(n).alias(n) for n in rules])
    grid = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    return grid.join(hits, ["px", "py"], "left").select("px", "py", *[F.coalesce(n, F.lit(False)).alias(n) for n in rules])


def differs(pixel: list[Column], background: list[Column], threshold: int) -> Column:
    return F.greatest(*[F.abs(p - b) for p, b in zip(pixel, background)]) >= threshold


def mask_stats(mask: DataFrame, name: str, width: int, height: int, cells: tuple[int, int] = (32, 18)) -> DataFrame:
    """(pixels, coverage, occupied, isolated, perimeter): each pixel meets its eight neighbours by equality."""
    on = mask.filter(name).select("px", "py")
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    near = F.explode(F.array(*[F.struct((F.col("px") + i).alias("x"), (F.col("py") + j).alias("y"), F.lit(abs(i) + abs(j) == 1).alias("side")) for i, j in steps]))
    around = on.select(F.col("px").alias("nx"), F.col("py").alias("ny"), near.alias("n")).select("n.x", "n.y", "n.side")
    counts = around.groupBy("x", "y").agg(F.count(F.lit(1)).alias("around"), F.count_if("side").alias("sides"))
    each = on.join(counts, (F.col("px") == F.col("x")) & (F.col("py") == F.col("y")), "left").select("px", "py", F.coalesce("around", F.lit(0)).alias("around"), F.coalesce("sides", F.lit(0)).alias("sides"))
    cell = F.struct(F.floor(F.col("px") * cells[0] / width), F.floor(F.col("py") * cells[1] / height))
    return each.agg(
        F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) / (width * height)).alias("coverage"), (F.count_distinct(cell) / (cells[0] * cells[1])).alias("occupied"), F.count_if(F.col("around") == 0).alias("isolated"), F.coalesce(F.sum(4 - F.col("sides")), F.lit(0)).alias("perimeter")
    )


def _slide(mask: DataFrame, radius: int, f) -> DataFrame:
    rows = Window.partitionBy("py").orderBy("px").rowsBetween(-radius, radius)
    columns = Window.partitionBy("px").orderBy("py").rowsBetween(-radius, radius)
    return mask.withColumn("v", f("v").over(rows)).withColumn("v", f("v").over(columns))


def dilate_square(mask: DataFrame, radius: int) -> DataFrame:
    """A square's maximum is that of its columns' maxima: two sliding windows, no neighbour pairs."""
    return _slide(mask, radius, F.bool_or)


def erode_square(mask: DataFrame, radius: int) -> DataFrame:
    return _slide(mask, radius, F.bool_and)


def close_square(mask: DataFrame, radius: int) -> DataFrame:
    return erode_square(dilate_square(mask, radius), radius)


def bounded_gaps(mask: DataFrame, most: int) -> DataFrame:
    """Pixels off in runs of at most ``most`` that pixels on enclose along a row or a column."""

    def along(line: str, at: str) -> DataFrame:
        w = Window.partitionBy(line).orderBy(at)
        before = F.last(F.when(F.col("v"), F.col(at)), ignorenulls=True).over(w)
        after = F.first(F.when(F.col("v"), F.col(at)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return mask.withColumn("span", after - before - 1).filter(~F.col("v") & (F.col("span") <= most)).select("px", "py")

    return along("py", "px").union(along("px", "py")).distinct()


def support(mask: DataFrame, base: str, other: str) -> DataFrame:
    """(retained, unsupported): how much of the base the other keeps, and how much of the other the base lacks."""
    a, b = F.col(base), F.col(other)
    return mask.agg((F.count_if(a & b) / F.count_if(a)).alias("retained"), (F.count_if(b & ~a) / F.count_if(b)).alias("unsupported"))


def largest_delta(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def box_edges(nodes: DataFrame) -> DataFrame:
    """(key, from_x .. to_z): twelve edges per box; corners are numbered by three bits, edges join those that differ in one."""
    pairs = [(c, c | 1 << k) for c in range(8) for k in range(3) if not c >> k & 1]
    corner = lambda c: [F.col(f"{'max' if c >> k & 1 else 'min'}_{a}") for k, a in enumerate("xyz")]
    edge = lambda c, e: F.struct(*[v.alias(f"{n}_{a}") for n, p in (("from", c), ("to", e)) for a, v in zip("xyz", corner(p))])
    return nodes.select("key", F.explode(F.array(*[edge(c, e) for c, e in pairs])).alias("edge")).select("key", "edge.*")


def splat_pixels(spacing: Column, distance: Column, scale: float, factor: float, coverage: float, low: float, high: float) -> Column:
    """Pixels of a point's splat: its spacing projected at its distance."""
    return F.least(F.lit(high), F.greatest(F.lit(low), spacing * scale / F.greatest(distance, F.lit(1.0)) * factor * coverage))


def ellipse_axes(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Half axes of the ellipse of a symmetric 2 x 2 covariance [[a, b], [b, c]]: roots of its eigenvalues."""
    mean, spread = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    return F.sqrt(F.greatest(mean + spread, F.lit(0.0))), F.sqrt(F.greatest(mean - spread, F.lit(0.0)))
