"""The camera stream: events in, the newest view per session out; bursts are debounced, repeats dropped.

The same operators run over a table (windows) and over a stream (session windows and keyed state).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratacloud.storage import shared_dir

DEBOUNCE = "30 minutes"
PREVIEW, DETAIL, WARMUP = 4, 3, 2


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream over event files as they come."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)


def debounced(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Events after which a session stays quiet for the gap. Works on streams too: a burst is a session window."""
    window = F.session_window("ts", gap)
    return events.groupBy("user_id", window.alias("burst")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events")).drop("burst")


def newest(events: DataFrame) -> DataFrame:
    """Per session its newest event: the request that supersedes all others."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("last")).select("user_id", "last.ts", "last.event_id", "last.value")


def run_to_end(frame: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame | StreamingQuery:
    """Process all that is there and stop. Without a sink the result is a table of files, a folder per micro-batch.

    A batch that runs again writes its folder again, so each counts once. In mode complete the last batch is the result.
    """
    spark = frame.sparkSession
    root = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = sink or (lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}"))
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if sink is not None:
        return q
    epochs = [p["batchId"] for p in q.recentProgress if p["numInputRows"] or mode == "complete"] or [q.lastProgress["batchId"]] if q.lastProgress else []
    if not epochs:
        return spark.createDataFrame([], frame.schema)
    paths = [f"{root}/out/epoch={e}" for e in (epochs[-1:] if mode == "complete" else sorted(set(epochs)))]
    return spark.read.schema(frame.schema).parquet(*paths)


def request_priority(request: Column, kind: Column) -> Column:
    """Newer requests first; within one preview before detail before warm-up."""
    return request * 10 + F.when(kind == "preview", PREVIEW).when(kind == "detail", DETAIL).when(kind == "warmup", WARMUP).otherwise(0)


def superseded(events: DataFrame, overlap: float = 0.35) -> DataFrame:
    """Adds ``reuses``: whether a request's node is in the family of the one before it in its session."""
    from stratacloud.functions.keys import is_ancestor

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("key").over(w)
    related = (is_ancestor(F.col("before"), F.col("key")) | is_ancestor(F.col("key"), F.col("before"))).cast("double")
    return events.withColumn("before", before).withColumn("reuses", F.coalesce(related >= overlap, F.lit(False))).drop("before")


class CameraStream:
    """A long-lived query: each micro-batch runs the view of every session's newest camera.

    ``view(batch, epoch)`` gets the newest events per session. State between batches (the last view per session) is kept
    by the caller's sink or by ``streaming.budget``.
    """

    def __init__(self, events: DataFrame, view: Callable[[DataFrame, int], None]):
        self.events, self.view, self.query = events, view, None

    def start(self, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = self.events.writeStream.foreachBatch(lambda batch, epoch: self.view(newest(batch), epoch)).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
