"""Streams: resumable file ingest, idempotent upserts, progress that is emitted on change, and windows over events.

Windows are an extension; the other three are what a document service does batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.tables import exists, new_path


def work_folder(spark: SparkSession) -> str:
    """A new folder beneath the shared one."""
    return new_path(spark, "stream")


def new_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 10) -> DataFrame:
    """A stream of a folder's Parquet files, some at a time; with a checkpoint it goes on where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def upsert(stream: DataFrame, key: str, target: str, checkpoint: str):
    """Appends rows whose key the target lacks; running a batch again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates([key])
        if exists(spark, target):  # the first batch has no target yet; of later ones only the keys are read
            new = new.join(spark.read.schema(df.schema).parquet(target).select(key), key, "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, late rows beyond the watermark dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
