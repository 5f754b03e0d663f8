"""A windowed count over the events stream, as an example of running the operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on a stream (with a watermark) and on a table."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.withWatermark("ts", late) if t.isStreaming else t
    return t.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
