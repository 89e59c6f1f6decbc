"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary folder is made and set. On a cluster that would
    be another folder on every machine, so it is an error there.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not current.isDefined() and not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='stratacloud-')}"
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")
