"""Coordinate systems: detection, WKT parts, geographic identity, Lambert conformal conic in closed form."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Definition of EPSG:2992 on GRS80, and units.
LCC_2992 = {"lat_0": 41.75, "lon_0": -120.5, "lat_1": 43.0, "lat_2": 45.5, "x_0": 400000.0, "y_0": 0.0, "to_meter": 0.3048}
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
US_SURVEY_FOOT = 0.304800609601219
#: Keywords of horizontal systems in WKT 1 and 2, projected ones first.
HORIZONTAL = ("PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS", "GEODCRS")
_TOKEN = re.compile(r'"[^"]*"|(?P<word>\w*)\s*\[|\]')


@dataclass(frozen=True)
class Lambert:
    """Constants of a two-parallel Lambert conformal conic projection."""

    n: float
    f: float
    rho0: float
    lon0: float
    x0: float
    y0: float
    unit: float
    e: float

    @classmethod
    def of(cls, lat_0: float, lon_0: float, lat_1: float, lat_2: float, x_0: float, y_0: float, to_meter: float) -> Lambert:
        e = math.sqrt(2 * GRS80_F - GRS80_F**2)
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p0, p1, p2 = map(math.radians, (lat_0, lat_1, lat_2))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        f = m(p1) / (n * t(p1) ** n)
        return cls(n, f, GRS80_A * f * t(p0) ** n, math.radians(lon_0), x_0, y_0, to_meter, e)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Degrees to projected units."""
        phi = F.radians(lat)
        es = self.e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(self.e / 2))
        rho = GRS80_A * self.f * F.pow(t, F.lit(self.n))
        theta = self.n * (F.radians(lon) - self.lon0)
        return (rho * F.sin(theta) + self.x0) / self.unit, (self.rho0 - rho * F.cos(theta) + self.y0) / self.unit

    def inverse(self, x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
        """Projected units to degrees. The latitude's fixed point is reached in a few unrolled rounds."""
        dx, dy = x * self.unit - self.x0, self.rho0 - (y * self.unit - self.y0)
        rho = F.sqrt(dx * dx + dy * dy)
        t = F.pow(rho / (GRS80_A * self.f), F.lit(1 / self.n))
        phi = math.pi / 2 - 2 * F.atan(t)
        fold = F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)), phi, lambda p, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - self.e * F.sin(p)) / (1 + self.e * F.sin(p)), F.lit(self.e / 2)))
        )
        return F.degrees(F.atan2(dx, dy) / self.n + self.lon0), F.degrees(fold)


EPSG_2992 = Lambert.of(**LCC_2992)


def is_geographic(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return (min_x >= -180) & (max_x <= 180) & (min_y >= -90) & (max_y <= 90)


def is_epsg_2992(wkt: Column) -> Column:
    return F.coalesce(wkt.contains('AUTHORITY["EPSG","2992"]'), F.lit(False))


def _tight(wkt: Column) -> Column:
    """The definition without blanks around its brackets and commas."""
    return F.regexp_replace(wkt, r"\s*([\[\],])\s*", "$1")


def epsg_code(wkt: Column) -> Column:
    """The last code named, as EPSG:n: WKT 1 names it by AUTHORITY, WKT 2 by ID."""
    codes = F.regexp_extract_all(_tight(wkt), F.lit(r'(?i)\b(AUTHORITY|ID)\["EPSG","?([0-9]+)'), F.lit(2))
    return F.when(F.size(codes) > 0, F.concat(F.lit("EPSG:"), F.element_at(codes, -1)))


def height_scale(wkt: Column) -> Column:
    """Metres per vertical unit: the unit that the vertical part names, or survey feet where a known datum says so, or 1."""
    vertical = F.regexp_extract(_tight(wkt), r"(?is)VERT(_CS|_CRS|CRS|ICALCRS)\[(.*)", 2)
    number = F.regexp_extract(vertical, r'(?i)UNIT\["[^"]+",([^,\]]+)', 1).try_cast("double")
    feet = F.coalesce(wkt.contains('VERT_CS["NAVD88 height (ftUS)"'), F.lit(False))
    return F.when((number > 0) & (number < float("inf")), number).when(feet, US_SURVEY_FOOT).otherwise(1.0)


def blocks(wkt: str) -> tuple[dict[str, list[tuple[int, int]]], list[str]]:
    """Start and end of every closed block by its keyword, and the keywords of blocks that never close."""
    closed: dict[str, list[tuple[int, int]]] = {}
    stack: list[tuple[str, int]] = []
    for token in _TOKEN.finditer(wkt):
        if token[0].endswith("["):
            stack.append((token["word"].upper(), token.start()))
        elif token[0] == "]" and stack:
            word, start = stack.pop()
            closed.setdefault(word, []).append((start, token.end()))
    return closed, [word for word, _ in stack]


def horizontal_block(wkt: str) -> str:
    """The horizontal part of a definition, or all of it where it names none. One that never closes is an error."""
    text = wkt.strip()
    closed, unclosed = blocks(text)
    for word in HORIZONTAL:
        if word in unclosed:
            raise ValueError(f"{word} is not closed")
        if word in closed:
            start, end = min(closed[word])
            return text[start:end]
    return text


def horizontal_wkt(wkt: Column) -> Column:
    """``horizontal_block`` of a column, in batches; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(horizontal_block, na_action="ignore")

    return run(wkt)


def crs_status(wkt: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """epsg:2992, wkt, geographic, or null where nothing is known."""
    return F.when(is_epsg_2992(wkt), "epsg:2992").when(wkt.isNotNull() & (wkt != ""), "wkt").when(is_geographic(min_x, min_y, max_x, max_y), "geographic")
