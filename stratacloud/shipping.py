"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT = "_stratacloud_sent"
#: Rows of an Arrow batch. Rows may hold long texts, and a batch is held by the executor and its Python worker at once.
BATCH_ROWS = 2_000


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per context; harmless where they can import it already.

    Arrow batches are made smaller than Spark's 10,000 rows unless the session has a size of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, _SENT, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="stratacloud-"), "stratacloud_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(root, "stratacloud")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
        pipeline = os.path.join(root, "corpus_pipeline.py")
        if os.path.exists(pipeline):
            out.write(pipeline, "corpus_pipeline.py")
    context.addPyFile(archive)
    setattr(context, _SENT, True)
