"""Streaming forms, beyond the batch profile: lookup of arriving requests, and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.match import lookup
from callscope.settings import Settings


def lookup_stream(requests: DataFrame, known: DataFrame, sink: str, checkpoint: str, settings: Settings = Settings(), **trigger):
    """A query that looks up every arriving request and appends the answers as Parquet.

    Each micro-batch is the batch lookup, so a replayed batch gives the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        lookup(batch, known, settings).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n): tumbling counts with a watermark for late rows; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def repeated_requests(requests: DataFrame, within: str = "5 seconds") -> DataFrame:
    """Arriving requests (ts, key, request_id) without those whose key arrived within the span; state is dropped behind the watermark."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])
