"""Planning byte ranges: coalescing node ranges, fixed blocks, runs of missing blocks, range caches.

Ranges that depend on the ones before (a length cap) are one sorted pass per file; the rest are joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64 * 1024
MOST_SPAN = 2 * 1024 * 1024


_SPANS = pa.schema([("source", pa.string()), ("key", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("span_begin", pa.int64()), ("span_end", pa.int64())])


def _spans(most_gap: int, most_span: int):
    """One pass over ranges that come sorted by source and place; only the open span is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, span, done = None, [], []

        def close() -> None:
            done.extend((source, k, b, e, span[0][1], span[-1][2]) for k, b, e in span)
            span.clear()

        for batch in batches:
            for s, k, b, e in zip(*(c.to_pylist() for c in batch.columns)):
                if span and (s != source or not 0 <= b - span[-1][2] <= most_gap or e - span[0][1] > most_span):
                    close()
                source = s
                span.append((k, b, e))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SPANS)], schema=_SPANS)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SPANS)], schema=_SPANS)

    return run


def coalesce_ranges(entries: DataFrame, most_gap: int = 0, most_span: int | None = MOST_SPAN, by: str = "source") -> DataFrame:
    """(source, key, begin, length) to (source, key, begin, end, span_begin, span_end).

    In the order of begins a range joins the open span if it starts at its end or at most ``most_gap`` after it and the
    span stays within ``most_span``. An overlap starts a new span. Empty ranges stand alone and leave the open span open.
    A key that comes twice in a source is an error. Without a cap on spans this is a window; with one, each span depends
    on the one before, and a sorted pass per source holds no more than the open span.
    """
    twice = F.count(F.lit(1)).over(Window.partitionBy(by, "key")) > 1
    once = F.when(twice, F.raise_error(F.lit("a key comes twice"))).otherwise(F.col("key")).cast("string")
    rows = entries.select(F.col(by).cast("string").alias("source"), once.alias("key"), F.col("begin").cast("bigint").alias("begin"), (F.col("begin") + F.col("length")).cast("bigint").alias("end"))
    alone = rows.filter("end <= begin").select("source", "key", "begin", "end", F.col("begin").alias("span_begin"), F.col("begin").alias("span_end"))
    full = rows.filter("end > begin")
    if most_span is None:
        order = Window.partitionBy("source").orderBy("begin", "end", "key")
        gap = F.col("begin") - F.lag("end").over(order)
        named = full.withColumn("new", F.when(gap.between(0, most_gap), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
        whole = Window.partitionBy("source", "island")
        spans = named.select("source", "key", "begin", "end", F.min("begin").over(whole).alias("span_begin"), F.max_by("end", F.struct("begin", "end", "key")).over(whole).alias("span_end"))
    else:
        spans = full.repartition("source").sortWithinPartitions("source", "begin", "end", "key").mapInArrow(_spans(most_gap, most_span), "source string, key string, begin bigint, end bigint, span_begin bigint, span_end bigint")
    return spans.unionByName(alone).withColumnRenamed("source", by)


def islands(entries: DataFrame, by: str = "source") -> DataFrame:
    """As above without a cap on lengths: gaps and islands by windows, nothing gathered in one row."""
    w = Window.partitionBy(by).orderBy("begin", "end", "key")
    e = entries.withColumn("end", F.col("begin") + F.col("length")).filter("length > 0")
    e = e.withColumn("new", F.coalesce((F.col("begin") != F.lag("end").over(w)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    whole = Window.partitionBy(by, "island")
    return e.select(by, "key", "begin", "end", F.min("begin").over(whole).alias("span_begin"), F.max("end").over(whole).alias("span_end"))


def blocks(requests: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per request and aligned block that it touches, with the block's ends."""
    last = F.floor((F.col("end") - 1) / size)
    return requests.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), last))).withColumn("block_begin", F.col("block") * size).withColumn("block_end", (F.col("block") + 1) * size)


def missing_runs(wanted: DataFrame, stored: DataFrame, by: str = "request") -> DataFrame:
    """(request, first_block, last_block): neighbouring blocks that the store lacks, as one fetch each."""
    lack = wanted.select(by, "block").distinct().join(stored.select("block").distinct(), "block", "left_anti")
    island = F.col("block") - F.row_number().over(Window.partitionBy(by).orderBy("block"))
    return lack.withColumn("island", island).groupBy(by, "island").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block")).drop("island")


def capped_runs(runs: DataFrame, most_blocks: int) -> DataFrame:
    """Runs cut so that none fetches more than ``most_blocks``."""
    cut = runs.withColumn("start", F.explode(F.sequence("first_block", "last_block", F.lit(most_blocks).cast("bigint"))))
    return cut.select(*[c for c in runs.columns if c not in ("first_block", "last_block")], F.col("start").alias("first_block"), F.least(F.col("start") + most_blocks - 1, F.col("last_block")).alias("last_block"))


def cache_hits(requests: DataFrame, cached: DataFrame, size: int = BLOCK) -> DataFrame:
    """(request, entry): the cached range that serves a request: the exact one, else the latest used that contains it.

    A cached range is filed under every block it touches, a request looks under its first one: an equality join.
    """
    filed = blocks(cached.select("entry", F.col("begin").alias("c_begin"), F.col("end").alias("c_end"), "used").withColumnRenamed("c_begin", "begin").withColumnRenamed("c_end", "end"), size).select("entry", F.col("begin").alias("c_begin"), F.col("end").alias("c_end"), "used", "block")
    asked = requests.withColumn("block", F.floor(F.col("begin") / size))
    found = asked.join(filed, "block").filter("c_begin <= begin and c_end >= end")
    exact = ((F.col("c_begin") == F.col("begin")) & (F.col("c_end") == F.col("end"))).cast("int")
    return found.groupBy("request").agg(F.max_by("entry", F.struct(exact, F.col("used"), F.col("entry"))).alias("entry"))


def evicted(entries: DataFrame, most_bytes: int, most_entries: int, by: str = "source") -> DataFrame:
    """Entries (entry, bytes, used) that don't fit: the latest used are kept while sums and counts hold."""
    w = Window.partitionBy(by).orderBy(F.col("used").desc(), F.col("entry").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("held", F.sum("bytes").over(w)).withColumn("nth", F.count(F.lit(1)).over(w)).filter((F.col("held") > most_bytes) | (F.col("nth") > most_entries)).drop("held", "nth")


def inner_slice(data: Column, inner_begin: Column, inner_end: Column, outer_begin: Column, outer_end: Column) -> Column:
    """The bytes of an inner range out of a fetched one that holds it."""
    good = (inner_begin >= outer_begin) & (inner_end <= outer_end)
    return F.when(good, F.substring(data, inner_begin - outer_begin + 1, inner_end - inner_begin)).otherwise(F.raise_error(F.lit("a range outside its fetch")))
