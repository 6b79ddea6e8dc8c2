"""Incremental runs with Structured Streaming: new files of paragraphs or events, each processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters


def label_new_files(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Label the paragraphs (section, paragraph) of the files that came since the last call and append them as Parquet.
    score adds more columns to each micro-batch. The checkpoint makes a repeated or failed call safe: a batch is written
    under its number and replaced if it comes again."""
    stream = spark.readStream.schema(schema).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("label", filters.heuristic_label(F.col("section"), F.col("paragraph")))
        (score(rows) if score else rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, cluster, n, total of a stream (or table) of events by tumbling windows, with a watermark for late rows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every), "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "cluster", "n", "total")
