"""Version selection over a stream of raw rows (an extension: the batch rules, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators.versions import latest_one

_RULE = "key array<string>, version string, tie string"


def keep_current(stream: DataFrame, target: str, checkpoint: str, key: list[str], version: str, tie: str) -> StreamingQuery:
    """Keeps the current version per key of a stream, at a cost that follows each micro-batch and not what came before.

    A batch writes only its own winners, to ``target/<batch>``; a repeated batch
    overwrites its own output, so a restart changes nothing. Reading (``read_kept``)
    picks the winner among batches; ``compact`` folds old batches into one.
    """
    columns = stream.columns

    def fold(batch: DataFrame, number: int) -> None:
        if number == 0:
            rule = batch.sparkSession.createDataFrame([(key, version, tie)], _RULE)
            rule.coalesce(1).write.mode("overwrite").json(f"{target}/_rule")
        latest_one(batch.select(*columns), key, [F.col(version).desc(), F.col(tie)]).write.mode("overwrite").parquet(f"{target}/{number:09d}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_kept(spark: SparkSession, target: str, number: int, since: int = 0) -> DataFrame:
    """The current versions after batch ``number``; ``since``: the batch that older ones were folded into."""
    rule = spark.read.schema(_RULE).json(f"{target}/_rule").first()
    rows = spark.read.parquet(*[f"{target}/{n:09d}" for n in range(since, number + 1)])
    return latest_one(rows, rule["key"], [F.col(rule["version"]).desc(), F.col(rule["tie"])])


def compact(spark: SparkSession, target: str, number: int, since: int = 0) -> None:
    """Folds the batches from ``since`` to ``number`` into ``target/compacted-<number>``: the base of later reads, once moved in place of batch ``number``."""
    read_kept(spark, target, number, since).write.mode("overwrite").parquet(f"{target}/compacted-{number:09d}")


def windowed_counts(stream: DataFrame, time_col: str = "ts", late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Counts and sums per day and type; rows later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
