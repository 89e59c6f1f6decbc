"""The facade: a point cloud that is loaded, selected from, sampled, drawn and streamed; and its extension points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud import fixtures
from stratacloud.functions.color import attribute_color, elevation_color, elevation_position
from stratacloud.operators.sampling import node_budgets, prefix, ranked, sample
from stratacloud.operators.tree import lenient_closure, strict_closure
from stratacloud.plans.selection import Camera, select_nodes

#: A user transform: columns x, y, z to longitude, latitude, height.
Transform = Callable[[Column, Column, Column], tuple[Column, Column, Column]]
#: A user's sampler: points and (key, budget) to the points that are drawn.
Sampler = Callable[[DataFrame, DataFrame], DataFrame]


def projected_transform(horizontal: Callable[[Column, Column], tuple[Column, Column]], height_scale: float = 1.0) -> Transform:
    """A transform from a horizontal projection, given as a column builder, and a vertical unit."""
    if not height_scale > 0:
        raise ValueError("the height scale must be positive")

    def run(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        lon, lat = horizontal(x, y)
        return lon, lat, z * height_scale

    return run


def geographic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, y, z


#: Depth at which subtrees become pages of the catalog.
PAGE_DEPTH = 2


class Sink:
    """Where frames go. Override ``write``; ``write_batches`` is used where a sink takes packed nodes."""

    def write(self, frame: DataFrame, revision: int) -> None:
        raise NotImplementedError

    @property
    def takes_batches(self) -> bool:
        return type(self).write_batches is not Sink.write_batches

    def write_batches(self, frame: DataFrame, revision: int) -> None:
        self.write(frame, revision)


class ParquetSink(Sink):
    """Every revision as a folder of Parquet files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, frame: DataFrame, revision: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/revision={revision}")


@dataclass
class PointCloud:
    """Points and the catalog of their octree."""

    points: DataFrame
    nodes: DataFrame
    transform: Transform = geographic
    sink: Sink | None = None
    revision: int = 0
    sampler: Sampler = sample

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, **options) -> PointCloud:
        """The catalog is kept, as every step asks it and it is small; points are read anew."""
        return cls(fixtures.points(spark, sf_dir), fixtures.nodes(spark, sf_dir).persist(), **options)

    def inspect(self) -> DataFrame:
        """One row of metadata."""
        p = self.points
        return p.agg(F.count(F.lit(1)).alias("point_count"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])

    def select(self, camera: Camera, mode: str = "complete", ancestors: bool = True, strict: bool = False) -> DataFrame:
        """Catalog rows that the camera gets, with their ancestors unless told otherwise."""
        chosen = select_nodes(self.nodes, camera, mode)
        if not ancestors:
            return self.nodes.join(chosen, "key", "left_semi")
        return strict_closure(chosen, self.nodes) if strict else lenient_closure(chosen, self.nodes)

    def sample(self, nodes: DataFrame, total: int, per_node: int) -> DataFrame:
        """Points of the nodes, each node's share of the total from the front of its progressive order."""
        return self.sampler(self.points, node_budgets(nodes, total, per_node))

    def node_sample(self, key: str, count: int | None = 5_000) -> DataFrame:
        """The first ``count`` points of a node; with None all of them, in no order."""
        whole = self.points.filter(F.col("node_key") == key)
        return whole if count is None else prefix(whole, count)

    def project(self, sampled: DataFrame, elevation: bool = False) -> DataFrame:
        """(point_id, node_key, lon, lat, height, rgb) of sampled points."""
        if elevation:
            box = self.points.agg(F.min("z").alias("low"), F.max("z").alias("high"))
            sampled = sampled.crossJoin(F.broadcast(box))
            rgb = elevation_color(elevation_position(F.col("z"), F.col("low"), F.col("high")))
        else:
            rgb = attribute_color(*[F.col(c) for c in ("red", "green", "blue", "classification", "intensity")])
        lon, lat, height = self.transform(F.col("x"), F.col("y"), F.col("z"))
        return sampled.select("point_id", "node_key", lon.alias("lon"), lat.alias("lat"), height.alias("height"), rgb.cast("bigint").alias("rgb"))

    def render(self, camera: Camera, total: int, per_node: int, mode: str = "complete") -> DataFrame:
        """Select, close, sample and project; the frame goes to the sink if there is one."""
        frame = self.project(self.sample(self.select(camera, mode), total, per_node))
        if self.sink is not None:
            self.revision += 1
            self.sink.write(frame, self.revision)
        return frame

    # --- the catalog in pages: subtrees below a depth are loaded one by one -------------------------------------------

    def page_of(self) -> DataFrame:
        """Catalog rows with the page that each lies in: ``root`` down to PAGE_DEPTH - 1, then its subtree."""
        from stratacloud.functions.keys import ancestor_keys

        return self.nodes.withColumn("page", F.when(F.col("depth") < PAGE_DEPTH, "root").otherwise(F.get(ancestor_keys(F.col("key")), F.lit(PAGE_DEPTH))))

    def pending_pages(self, loaded: DataFrame) -> DataFrame:
        """(page) of subtrees that are not loaded yet; loaded: (page)."""
        return self.page_of().select("page").distinct().filter("page <> 'root'").join(loaded, "page", "left_anti")

    def load_page(self, loaded: DataFrame, page: str) -> DataFrame:
        """The loaded pages with one more; a page that isn't in the catalog is an error."""
        if self.pending_pages(loaded).filter(F.col("page") == page).isEmpty():
            raise KeyError(page)
        return loaded.unionByName(self.nodes.sparkSession.createDataFrame([(page,)], "page string"))

    def load_next_page(self, loaded: DataFrame) -> DataFrame:
        """The loaded pages with the first pending one in catalog order, if there is any."""
        from stratacloud.functions.keys import parse_key

        k = parse_key(F.col("page"))
        first = self.pending_pages(loaded).orderBy(k["depth"], k["z"], k["y"], k["x"]).limit(1)
        return loaded.unionByName(first)

    def with_pages(self, loaded: DataFrame) -> PointCloud:
        """The cloud as far as its catalog is loaded."""
        known = self.page_of().join(loaded.unionByName(self.nodes.sparkSession.createDataFrame([("root",)], "page string")), "page", "left_semi").drop("page")
        return PointCloud(self.points, known, self.transform, self.sink, self.revision, self.sampler)

    def progressive(self, camera: Camera, total: int, per_node: int, batch: int, on_progress: Callable[[DataFrame, int], bool] | None = None) -> int:
        """Draw the selection in batches of nodes, shallow ones first; stops when ``on_progress`` says so. Returns the batches."""
        from pyspark.sql import Window

        chosen = self.select(camera)
        order = Window.orderBy("depth", "z", "y", "x")
        turns = chosen.withColumn("turn", F.floor((F.row_number().over(order) - 1) / batch)).persist()
        last = turns.agg(F.max("turn")).first()[0]
        done = 0
        for turn in range(0 if last is None else last + 1):
            frame = self.project(self.sample(turns.filter(F.col("turn") <= turn).drop("turn"), total, per_node))
            done += 1
            if self.sink is not None:
                self.revision += 1
                self.sink.write(frame, self.revision)
            if on_progress is not None and on_progress(frame, turn):
                break
        turns.unpersist()
        return done

    def warm(self) -> PointCloud:
        """The ranked points kept: every later sample is a filter on them."""
        self.points = ranked(self.points).persist()
        return self

    def close(self) -> None:
        self.points.unpersist()
        self.nodes.unpersist()
