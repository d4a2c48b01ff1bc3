"""Deliveries that arrive as files: a stream over a drop folder, and fixed slots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_batches(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Applies a batch stage to what has arrived; a batch is written once under its number."""

    def each(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slots(events: DataFrame, time: str, minutes: int, late: str | None = None) -> DataFrame:
    """Events a slot of fixed length; `late` sets a watermark for streams."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, f"{minutes} minutes").alias("slot")).agg(F.count("*").alias("n")).select(F.col("slot.start").alias("slot_start"), "n")


def stale(jobs: DataFrame, heartbeat: str, now, seconds: int) -> DataFrame:
    return jobs.where(F.unix_timestamp(now) - F.unix_timestamp(heartbeat) > seconds)
