"""Runs that can stop at any time and go on: micro-batches appended, the last line of an id wins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import checkpoint_folder


class Interrupted(RuntimeError):
    """A run that was told to stop after a batch."""


def append_batches(stream: DataFrame, sink: str, checkpoint: str, transform=None, stop_after: int | None = None):
    """Starts a query that appends each micro-batch to `sink`, with its number; a batch run again replaces itself.

    Delivery is at least once per file and exactly once per batch number, as a batch writes its own folder.
    stop_after: breaks off once that batch is written but not yet committed, as a lost driver would.
    """

    def write(batch: DataFrame, n: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        if stop_after is not None and n >= stop_after:
            raise Interrupted(f"batch {n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/marginalia-{uuid.uuid4().hex}"


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their values per window and type; the same plan for a table and a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        .select(F.col("w.start").alias("day"), "event_type", "n_events", "cents")
    )
