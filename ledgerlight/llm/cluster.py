"""Where intermediate tables live, and how lineage is cut.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``;
only where that is unset (tests, a laptop) is a local one made.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster, as a URI or path without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder, and executors share none with this machine")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    The table outlives executors, so later stages restart from it, not from the
    source; the shuffles that made it are dropped as soon as it is written, not when
    the driver collects garbage. An empty result is read back with its schema.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or the shortest that begins with it and is not taken."""
    while name in taken:
        name += "_"
    return name


def shipped(spark: SparkSession, model: object) -> Callable[[], object]:
    """Sends a bounded model to the executors once; tasks call what is returned to get it.

    The model's own classes travel with it, so executors need no copy of this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is counted to hold at most ``max_rows`` rows.

    Beyond that the plain DataFrame is returned and Spark joins by shuffling,
    with adaptive splitting of skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
