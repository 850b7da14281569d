"""Micro-batches over a file stream that continue where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, path: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1) -> None:
    """Feeds what is new under ``path`` to ``sink``, batch by batch; the checkpoint moves on after each success, and a failure ends the run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a former run has not completed."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
