"""Structured Streaming counterparts of the ingest checks: counts of events per window, and load deltas as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, kind, n, total): counts and sums per window; works on a stream (rows later than ``late`` are dropped) and on a table."""
    timed = events.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def follow(stream: DataFrame, store, make_deltas, checkpoint: str):
    """Applies the deltas of every micro-batch of ``stream`` to a value-count store; ``make_deltas(batch)`` gives them. Returns the query.

    A micro-batch is named by the query, which its checkpoint fixes, and its number, so one that is retried counts once.
    """
    query = hashlib.md5(checkpoint.encode(), usedforsecurity=False).hexdigest()
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: store.apply(make_deltas(batch), batch=f"{query}-{n}")).start()
