"""Incremental runs: new documents as a stream into the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(docs: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Documents without those whose key came within the watermark before."""
    return docs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(docs: DataFrame, at: str, key: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Documents per time window and key; windows close when the watermark passes."""
    return docs.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_available(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to every new micro-batch and appends its result; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
