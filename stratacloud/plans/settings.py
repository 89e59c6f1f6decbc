"""Quality presets, level-of-detail bands by camera height, and the budgets that follow from them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20


@dataclass(frozen=True)
class Quality:
    points_per_node: int
    rendered_points: int
    source_points: int
    node_points: int
    source_bytes: int
    node_bytes: int
    nodes: int
    depth: int
    node_pixels: float
    spacing_pixels: float
    auto_rendered_points: int
    auto_nodes: int
    auto_pages: int


# The four quality presets.
PRESETS = {
    "preview": Quality(20_000, 10_000, 250_000, 80_000, 6 * MIB, 2 * MIB, 12, 2, 220.0, 8.0, 20_000, 12, 3),
    "balanced": Quality(180_000, 360_000, 900_000, 80_000, 16 * MIB, 2 * MIB, 96, 5, 80.0, 4.0, 240_000, 32, 5),
    "detail": Quality(300_000, 720_000, 1_800_000, 160_000, 32 * MIB, 4 * MIB, 160, 6, 56.0, 2.5, 500_000, 64, 6),
    "ultra": Quality(500_000, 1_200_000, 3_600_000, 320_000, 64 * MIB, 8 * MIB, 256, 7, 42.0, 1.75, 1_000_000, 96, 7),
}


@dataclass(frozen=True)
class Band:
    top: float
    label: str
    least_depth: int
    node_pixels: float
    spacing_pixels: float
    node_factor: int
    point_factor: int
    pages: int
    node_cap: int
    least_nodes: int
    node_target: int


# Level-of-detail bands by camera height in metres; above the last one is the overview.
BANDS = [
    Band(350.0, "near zoom", 6, 48.0, 1.5, 3, 2, 5, 6_500, 16, 1_500),
    Band(700.0, "close zoom", 5, 64.0, 2.25, 2, 2, 4, 6_500, 12, 2_000),
    Band(1_500.0, "medium zoom", 5, 80.0, 3.5, 1, 2, 4, 6_000, 8, 2_500),
    Band(3_000.0, "wide zoom", 4, 110.0, 5.0, 1, 1, 3, 6_000, 6, 3_500),
]
OVERVIEW_NODE_CAP, OVERVIEW_LEAST_NODES, OVERVIEW_NODE_TARGET = 5_000, 4, 5_000
SETTLED_SHARE = 0.75


def by_band(height: Column, values: list, above) -> Column:
    """A value per band of the height."""
    out = None
    for band, v in zip(BANDS, values):
        out = (F if out is None else out).when(height <= band.top, v)
    return out.otherwise(above)


def lod_settings(heights: DataFrame, height: str = "height", preset: str = "balanced", base_pages: int = 2) -> DataFrame:
    """Adds label, max_nodes, max_depth, node_pixels, spacing_pixels, rendered_points, source_points, source_bytes, pages, node_cap, least_nodes, node_target."""
    q, h = PRESETS[preset], F.greatest(F.coalesce(F.col(height), F.lit(0.0)), F.lit(0.0))
    pick = lambda f, above: by_band(h, [f(b) for b in BANDS], above)
    return heights.select(
        "*",
        pick(lambda b: b.label, "overview").alias("label"),
        pick(lambda b: max(q.nodes, q.nodes * b.node_factor), q.nodes).cast("bigint").alias("max_nodes"),
        pick(lambda b: max(q.depth, b.least_depth), q.depth).cast("bigint").alias("max_depth"),
        pick(lambda b: min(q.node_pixels, b.node_pixels), q.node_pixels).alias("node_pixels"),
        pick(lambda b: min(q.spacing_pixels, b.spacing_pixels), q.spacing_pixels).alias("spacing_pixels"),
        pick(lambda b: q.rendered_points * b.point_factor, q.rendered_points).cast("bigint").alias("rendered_points"),
        pick(lambda b: q.source_points * b.point_factor, q.source_points).cast("bigint").alias("source_points"),
        pick(lambda b: q.source_bytes * b.point_factor, q.source_bytes).cast("bigint").alias("source_bytes"),
        pick(lambda b: max(base_pages, b.pages), base_pages).cast("bigint").alias("pages"),
        pick(lambda b: max(b.node_target, b.node_cap), OVERVIEW_NODE_CAP).cast("bigint").alias("node_cap"),
        pick(lambda b: b.least_nodes, OVERVIEW_LEAST_NODES).cast("bigint").alias("least_nodes"),
        pick(lambda b: b.node_target, OVERVIEW_NODE_TARGET).cast("bigint").alias("node_target"),
    )


def lod_target_spacing(height: Column, preset: str = "balanced") -> Column:
    q = PRESETS[preset]
    return F.when(height.isNotNull(), by_band(height, [min(q.spacing_pixels, b.spacing_pixels) for b in BANDS], q.spacing_pixels))


def zooms_in(before: Column, after: Column, spacing_before: Column, spacing_after: Column) -> Column:
    """Whether a camera move asks for finer detail: a stricter target, or a height under nine tenths of the last."""
    return F.coalesce(after < before * 0.9, F.lit(False)) | F.coalesce(spacing_after < spacing_before, F.lit(False))


def presets(spark: SparkSession) -> DataFrame:
    rows = [(name, *asdict(q).values()) for name, q in PRESETS.items()]
    return spark.createDataFrame(rows, ["preset", *asdict(PRESETS["preview"])])


def height_above(camera: Column, cloud_top: Column) -> Column:
    return F.greatest(camera - cloud_top, F.lit(0.0))


def default_camera_height(horizontal: Column, vertical: Column) -> Column:
    return F.greatest(F.lit(1200.0), horizontal * 2.5, vertical * 4)


def camera_to_source(lon: Column, lat: Column, inverse) -> tuple[Column, Column]:
    return inverse(lon, lat)


def direction_step(height: Column) -> Column:
    """How far ahead of the eye the end of its direction is laid."""
    return F.least(F.greatest(F.abs(height) * 0.02, F.lit(100.0)), F.lit(10_000.0))


def settled_threshold(target: Column) -> Column:
    return target * SETTLED_SHARE


def expansion_depth(configured: Column, selected: Column) -> Column:
    return F.least(configured, selected)


def worker_count(cores: Column, least: int = 1, most: int = 4) -> Column:
    """Two cores stay free."""
    return F.least(F.lit(most), F.greatest(F.lit(least), cores - 2))


def worker_bytes(total: Column, workers: Column, most: int = 192 * MIB) -> Column:
    return F.least(F.lit(most), F.floor(total / F.greatest(workers, F.lit(1))))


@dataclass(frozen=True)
class Prefetch:
    """Predictive loading: one level deeper and sharper targets than the view in hand."""

    depth: int
    node_pixels: float
    spacing_pixels: float

    @classmethod
    def of(cls, depth: int, node_pixels: float, spacing_pixels: float, most_depth: int) -> Prefetch:
        return cls(min(depth + 1, most_depth), max(24.0, node_pixels * 0.6), max(1.0, spacing_pixels * 0.6))


@dataclass(frozen=True)
class Runtime:
    """Knobs of the camera stream and their defaults."""

    debounce_ms: int = 30
    preview_points: int = 64_000
    preview_points_per_node: int = 8_000
    retained_samples: int = 1_024
    reuse_overlap: float = 0.35

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if not value > 0:
                raise ValueError(f"{name} must be positive")
        if self.reuse_overlap > 1:
            raise ValueError("reuse_overlap is a share")
