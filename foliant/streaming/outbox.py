"""Structured Streaming forms: replay of ordered mutations per key, and incremental rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(mutations: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Hand each micro-batch's last mutation per key to merge(batch, batch_id); a batch that is retried has the same id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c not in (key, order)]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_m"), F.max(order).alias(order))
        merge(last.select(key, order, "_m.*"), batch_id)

    return mutations.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kinds: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kinds).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kinds, "n")


def first_seen(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: idempotency receipts of a stream."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
