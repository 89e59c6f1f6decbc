"""Point colours: attributes, classes, intensity, elevation; packed 0xRRGGBB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratacloud.functions.geometry import finite, half_up

# Colours of the ASPRS classes.
CLASS_COLORS = {
    2: (166, 124, 82),
    3: (120, 184, 92),
    4: (72, 148, 65),
    5: (34, 105, 50),
    6: (210, 188, 172),
    7: (214, 72, 72),
    9: (52, 122, 183),
    10: (135, 103, 85),
    11: (80, 82, 86),
    13: (239, 199, 73),
    14: (245, 220, 82),
    15: (196, 116, 55),
    16: (224, 156, 67),
    17: (232, 143, 63),
    18: (190, 38, 45),
    19: (154, 118, 170),
    20: (128, 104, 76),
    21: (225, 238, 245),
    22: (116, 104, 138),
}
# Six stops of the elevation palette, neutral and default colours, grays of intensity.
ELEVATION_STOPS = [(68, 1, 84), (65, 68, 135), (42, 120, 142), (34, 168, 132), (122, 209, 81), (253, 231, 37)]
NEUTRAL = (158, 163, 168)
CYAN = (0, 255, 255)
GRAY_LOW, GRAY_HIGH = 48, 255


def pack(r: int, g: int, b: int) -> int:
    return r << 16 | g << 8 | b


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(c: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(c, 16).bitwiseAND(F.lit(255)), F.shiftright(c, 8).bitwiseAND(F.lit(255)), c.bitwiseAND(F.lit(255))


def color_component(v: Column) -> Column:
    """A colour channel of 8 or 16 bits as 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.when(v > 255, half_up(v / 257)).otherwise(half_up(v)))).cast("int")


def unsigned(v: Column, top: int) -> Column:
    """A whole number of 0..top; what isn't finite is 0."""
    return F.when(finite(v.cast("double")), F.greatest(F.lit(0), F.least(F.lit(top), half_up(v.cast("double"))))).otherwise(0).cast("int")


def class_color(classification: Column) -> Column:
    palette = F.create_map(*[F.lit(x) for k, c in CLASS_COLORS.items() for x in (k, pack(*c))])
    return F.try_element_at(palette, F.greatest(F.lit(0), F.least(F.lit(255), half_up(classification))).cast("int"))


def attribute_color(r: Column, g: Column, b: Column, classification: Column, intensity: Column) -> Column:
    """Full colour first, then the class, then gray by intensity, then a neutral or default colour."""
    gray = half_up(GRAY_LOW + F.sqrt(F.greatest(F.lit(0), F.least(F.lit(65535), intensity)) / 65535.0) * (GRAY_HIGH - GRAY_LOW))
    rest = F.when(intensity.isNotNull(), pack_rgb(gray, gray, gray)).when(classification.isNull(), pack(*CYAN)).otherwise(pack(*NEUTRAL))
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), pack_rgb(r, g, b)).otherwise(F.coalesce(class_color(classification), rest))


def elevation_position(z: Column, low: Column, high: Column) -> Column:
    """0..1 of a height in its file's range; the middle where that can't be told."""
    share = (z - low) / (high - low)
    return F.when(finite(z) & finite(low) & finite(high) & (high > low), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.5)


def elevation_color(position: Column) -> Column:
    at = position * (len(ELEVATION_STOPS) - 1)
    lower = F.least(F.floor(at), F.lit(len(ELEVATION_STOPS) - 1)).cast("int")
    upper = F.least(lower + 1, F.lit(len(ELEVATION_STOPS) - 1))
    channels = []
    for k in range(3):
        stops = F.array(*[F.lit(float(s[k])) for s in ELEVATION_STOPS])
        channels.append(half_up(F.get(stops, lower) + (F.get(stops, upper) - F.get(stops, lower)) * (at - lower)))
    return pack_rgb(*channels)
