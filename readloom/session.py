"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows that a Python worker gets at a time.
BATCH = 2_000


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the Python workers of the session, once, through Spark's own file distribution."""
    context = spark.sparkContext
    if getattr(context, "_readloom_shipped", False):
        return spark
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))  # texts may be long
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="readloom"), "readloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("readloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._readloom_shipped = True
    return spark
