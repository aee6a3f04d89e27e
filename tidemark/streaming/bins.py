"""Feature counts over streams, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, feature: str, width: str = "6 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(time_bin, feature, count) in tumbling or sliding windows, given out when the watermark passes a window."""
    span = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(span.alias("_w"), F.col(feature).alias("feature")).agg(F.count("*").alias("count")).select(F.col("_w.start").alias("time_bin"), "feature", "count")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, events) of runs of events with no longer gap between them."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap).alias("_s"), F.col(key).alias("key")).agg(F.count("*").alias("events")).select(
        "key", F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "events"
    )


def drain(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, exactly once, and gives what it wrote to ``name`` in ``folder``."""
    rows = f"{folder}/{name}"
    sink = stream.writeStream.outputMode("append").format("parquet").option("path", rows).option("checkpointLocation", f"{folder}/checkpoint-{name}")
    sink.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
