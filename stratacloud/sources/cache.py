"""A store of byte ranges that outlives sessions, and a reader that asks it first.

The store keeps whole aligned blocks per source. A user's store implements ``RangeCache``; ``FolderRangeCache`` keeps
blocks as Parquet, one folder per source.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.sources.files import file_length, read_ranges, source_key
from stratacloud.sources.ranges import BLOCK, blocks, capped_runs, missing_runs

_BLOCKS = "block bigint, data binary"


class RangeCache(ABC):
    """Blocks by source: (block, data). Each block is stored once."""

    @abstractmethod
    def blocks(self, source: str) -> DataFrame: ...

    @abstractmethod
    def add(self, source: str, found: DataFrame) -> None: ...

    @abstractmethod
    def delete(self, source: str) -> None: ...


class FolderRangeCache(RangeCache):
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, source: str) -> str:
        return f"{self.root}/{hashlib.sha256(source.encode()).hexdigest()}"

    def _path(self, source: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(source))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def blocks(self, source: str) -> DataFrame:
        path, files = self._path(source)
        return self.spark.read.schema(_BLOCKS).parquet(self._folder(source)) if files.exists(path) else self.spark.createDataFrame([], _BLOCKS)

    def add(self, source: str, found: DataFrame) -> None:
        found.write.mode("append").parquet(self._folder(source))

    def delete(self, source: str) -> None:
        path, files = self._path(source)
        files.delete(path, True)


class CachedRanges:
    """Reads ranges of one file through a store. ``fetched_blocks`` counts what the last read had to fetch."""

    def __init__(self, spark: SparkSession, path: str, store: RangeCache, block: int = BLOCK, most_blocks: int = 16):
        self.spark, self.path, self.store, self.block, self.most_blocks = spark, path, store, block, most_blocks
        self.source, self.fetched_blocks = source_key(path), 0

    def read(self, requests: DataFrame) -> DataFrame:
        """(request, begin, end) to (request, begin, end, data). A range beyond the end of the file is an error."""
        length = file_length(self.spark, self.path)
        checked = requests.withColumn("end", F.when((F.col("begin") < 0) | (F.col("end") <= F.col("begin")) | (F.col("end") > length), F.raise_error(F.lit("a range outside the file"))).otherwise(F.col("end")).cast("bigint"))
        wanted = blocks(checked, self.block)
        lack = missing_runs(wanted.select(F.lit(0).alias("request"), "block"), self.store.blocks(self.source).select("block"))
        runs = [(r["first_block"], r["last_block"]) for r in capped_runs(lack, self.most_blocks).collect()]
        self.fetched_blocks = sum(b - a + 1 for a, b in runs)
        if runs:
            found = read_ranges(self.spark, self.path, [(a * self.block, min((b + 1) * self.block, length)) for a, b in runs])
            cut = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / self.block), F.floor((F.col("end") - 1) / self.block))))
            at = F.col("block") * self.block - F.col("begin") + 1
            self.store.add(self.source, cut.select("block", F.substring("data", at.cast("int"), F.lit(self.block)).alias("data")))
        parts = wanted.join(self.store.blocks(self.source), "block")
        low, high = F.greatest("begin", "block_begin"), F.least("end", "block_end")
        part = F.struct("block", F.substring("data", (low - F.col("block_begin") + 1).cast("int"), (high - low).cast("int")).alias("part"))
        whole = F.array_sort(F.collect_list(part))
        joined = F.unhex(F.array_join(F.transform(whole, lambda p: F.hex(p["part"])), ""))
        return parts.groupBy("request", "begin", "end").agg(joined.alias("data"))
