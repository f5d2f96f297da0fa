"""Evidence and run events as streams: append-only logs and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """With an event time that watermarks accept."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def distinct_events(events: DataFrame, key: str = "event_id", column: str = "ts", late: str = "1 day") -> DataFrame:
    """Events once each, as long as repeats are no later than ``late``."""
    return timed(events, column).withWatermark(column, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, kind: str = "event_type", value: str = "value", column: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and sum of values by window and kind."""
    grouped = timed(events, column).withWatermark(column, late).groupBy(F.window(column, width), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")


def append_evidence(evidence: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of evidence rows to a table, each once."""
    return evidence.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
