"""Distances, screen sizes, cones and WGS84 geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
SEMI_MAJOR = 6378137.0
FIRST_ECCENTRICITY_SQUARED = 6.6943799901413165e-3
EPSILON = 2.0**-52


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards +infinity."""
    return F.floor(c + 0.5)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def cell_index(v: Column, depth: Column, extent: float) -> Column:
    cells = F.pow(F.lit(2.0), depth)
    return F.least(cells - 1, F.floor(v / extent * cells)).cast("bigint")


def gap(v: Column, low: Column, high: Column) -> Column:
    """Distance of a number to a range."""
    return F.greatest(low - v, v - high, F.lit(0.0))


def box_distance(tx: Column, ty: Column, tz: Column | None = None, prefix: str = "") -> Column:
    """Distance of a point to the box columns min_x .. max_z; without tz in the plane."""
    c = lambda n: F.col(prefix + n)
    d = [gap(tx, c("min_x"), c("max_x")), gap(ty, c("min_y"), c("max_y"))]
    if tz is not None:
        d.append(gap(tz, c("min_z"), c("max_z")))
    return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))


def horizontal_span(prefix: str = "") -> Column:
    return F.greatest(F.col(prefix + "max_x") - F.col(prefix + "min_x"), F.col(prefix + "max_y") - F.col(prefix + "min_y"))


def screen_pixels(size: Column, distance: Column, viewport: Column | float) -> Column:
    """Pixels that a length covers on screen: not nearer than its own size."""
    size = F.greatest(size, F.lit(EPSILON))
    return size / F.greatest(distance, size) * viewport


def inside(px: Column, py: Column, pz: Column) -> Column:
    return px.between(F.col("min_x"), F.col("max_x")) & py.between(F.col("min_y"), F.col("max_y")) & pz.between(F.col("min_z"), F.col("max_z"))


def in_view_cone(px: Column, py: Column, pz: Column, direction: tuple, cos_half: float) -> Column:
    """Whether a box may be seen: the eye is inside, or the box's sphere reaches into the cone."""
    centre = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"]
    half = [(F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in "xyz"]
    radius = F.sqrt(half[0] * half[0] + half[1] * half[1] + half[2] * half[2])
    d = [c - p for c, p in zip(centre, (px, py, pz))]
    distance = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    cosine = (d[0] * direction[0] + d[1] * direction[1] + d[2] * direction[2]) / F.greatest(distance, F.lit(EPSILON))
    angle = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
    slack = F.when(distance > radius, F.asin(radius / distance)).otherwise(F.lit(3.141592653589793))
    return inside(px, py, pz) | (distance <= radius) | (angle - slack <= F.acos(F.lit(cos_half)))


def ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred metres."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = SEMI_MAJOR / F.sqrt(1 - FIRST_ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - FIRST_ECCENTRICITY_SQUARED) + height) * F.sin(phi)


def frustum_passes(planes: list[tuple[float, float, float, float]], centre: tuple[Column, Column, Column], radius: Column) -> Column:
    """Whether a sphere is not wholly behind any plane (unit normal and offset)."""
    tests = [(centre[0] * a + centre[1] * b + centre[2] * c + d) >= -radius for a, b, c, d in planes]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
