"""Incremental intake: the batch operators over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_spans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through ``transform`` and lands below ``out`` under its number, so a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Without repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Spans and mean confidence by window, late rows up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
