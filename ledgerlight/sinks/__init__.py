"""Where tables are published, and where queries keep what they write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; only in local mode is one made where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder, and executors share none with this machine")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
