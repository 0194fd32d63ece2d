"""Queries over streams, each equal to its twin over the table."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.schemas import EVENT
from marginalia.streaming.resume import append_batches, read_stream, shared_folder
from marginalia.session import table


FILES = 4


def q_stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Events in several files, appended by micro-batches of a file each; the run breaks off with its second batch written but not committed, and goes on; the last event of each user wins."""
    base, events = shared_folder(spark), table(spark, d, "events")
    events.repartition(FILES, "event_id").write.parquet(f"{base}/in")
    stream = read_stream(spark, f"{base}/in", events.schema)
    try:
        append_batches(stream, f"{base}/sink", f"{base}/checkpoint", stop_after=1).awaitTermination()
    except StreamingQueryException:
        pass
    append_batches(stream, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{base}/sink")
    return done.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_event"))


def q_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type: event-time windows with a watermark."""
    from marginalia.streaming.resume import windowed_counts

    return windowed_counts(table(spark, d, "events"))


SQL = {
    "q_stream_resume": "SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_event FROM events GROUP BY user_id",
    "q_event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n_events, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
}
QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}
__all__ = ["EVENT", "QUERIES", "SQL", "read_stream"]
