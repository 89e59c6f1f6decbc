"""Shared and background work: results that several consumers wait for, and at most one prefetch at a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SharedTask:
    """A frame that several consumers share: kept while any of them holds it, its jobs cancelled when the last one leaves."""

    def __init__(self, spark: SparkSession, make: Callable[[], DataFrame]):
        self._spark, self._make = spark, make
        self._tag = f"shared-{uuid.uuid4().hex}"
        self._lock, self._frame, self._consumers, self.aborted = threading.Lock(), None, 0, False

    @classmethod
    def fulfilled(cls, frame: DataFrame) -> SharedTask:
        """A task whose result is there already."""
        task = cls(frame.sparkSession, lambda: frame)
        task._frame = frame
        return task

    @property
    def reusable(self) -> bool:
        return not self.aborted

    def consume(self) -> DataFrame:
        with self._lock:
            if self.aborted:
                raise RuntimeError("the task was aborted")
            if self._frame is None:
                self._frame = self._make().persist()
            self._consumers += 1
            return self._frame

    def run(self) -> int:
        """Make the frame now, under the task's tag, and return its rows."""
        self._spark.addTag(self._tag)
        try:
            return self.consume().count()
        finally:
            self._spark.removeTag(self._tag)

    def leave(self) -> None:
        with self._lock:
            self._consumers = max(0, self._consumers - 1)
            if self._consumers == 0 and not self.aborted:
                self.aborted = True
                self._spark.interruptTag(self._tag)
                if self._frame is not None:
                    self._frame.unpersist()


class Prefetch:
    """One background load at a time: a new one ends the one before."""

    def __init__(self):
        self.current: SharedTask | None = None

    def start(self, task: SharedTask) -> SharedTask:
        self.cancel()
        self.current = task
        task.consume()
        return task

    def cancel(self) -> None:
        if self.current is not None:
            self.current.leave()
            self.current = None


def runs_engine(layer: object) -> bool:
    """Whether an object can be driven by the camera stream: it selects, samples and draws."""
    return all(callable(getattr(layer, name, None)) for name in ("select", "sample", "render"))


def prefetches(log: DataFrame, session: str) -> DataFrame:
    """A log of background loads (event_id, ts, done) with ``aborted``: whether the next one of its session came before it was done."""
    after = F.lead("ts").over(Window.partitionBy(session).orderBy("ts", "event_id"))
    return log.withColumn("aborted", F.coalesce(after < F.col("done"), F.lit(False)))
