"""Reading byte ranges of files as a Spark data source: one task per range, read with exact lengths."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES = 256 * 1024 * 1024


class RangePartition(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class ByteRangeReader(DataSourceReader):
    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        self.path, self.ranges = path, ranges

    def partitions(self):
        return [RangePartition(*r) for r in self.ranges]

    def read(self, partition):
        if not 0 <= partition.begin < partition.end or partition.end - partition.begin > MOST_BYTES:
            raise ValueError(f"bad range {partition.begin}-{partition.end}")
        with open(self.path, "rb") as f:
            f.seek(partition.begin)
            data = f.read(partition.end - partition.begin)
        if len(data) != partition.end - partition.begin:
            raise EOFError(f"{len(data)} bytes of {partition.end - partition.begin}")
        yield partition.begin, partition.end, data


class ByteRangeSource(DataSource):
    """``spark.read.format("byteranges").option("path", p).option("ranges", "0-64,128-256").load()``; ranges are half-open.

    The path must be one that executors can open; files elsewhere are read whole by ``binaryFile``.
    """

    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return "begin long, end long, data binary"

    def reader(self, schema):
        ranges = [tuple(int(x) for x in r.split("-")) for r in self.options.get("ranges", "").split(",") if r]
        return ByteRangeReader(os.path.expanduser(self.options["path"]), ranges)


def file_length(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def read_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """(begin, end, data) of half-open ranges: a task per range where executors can open the path, else cut from the whole file."""
    local = path.removeprefix("file://") if path.startswith("file:///") else path
    if "://" not in local:
        spark.dataSource.register(ByteRangeSource)
        return spark.read.format("byteranges").option("path", local).option("ranges", ",".join(f"{a}-{b}" for a, b in ranges)).load()
    whole = spark.read.format("binaryFile").load(path).withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("begin"), F.lit(b).cast("bigint").alias("end")) for a, b in ranges])))
    data = F.substring("content", (F.col("r.begin") + 1).cast("int"), (F.col("r.end") - F.col("r.begin")).cast("int"))
    exact = F.when(F.col("r.end") > F.col("length"), F.raise_error(F.lit("a range outside the file"))).otherwise(data)
    return whole.select("r.begin", "r.end", exact.cast("binary").alias("data"))


def source_key(path: str) -> str:
    return f"url:{path}"


class Sources:
    """Names of sources: addresses name themselves, blobs get numbers in the order they come."""

    def __init__(self):
        self._blobs: dict[int, str] = {}

    def key(self, source) -> str:
        if isinstance(source, str):
            return source_key(source)
        return self._blobs.setdefault(id(source), f"blob:{len(self._blobs) + 1}")
