"""Structured Streaming forms: scoring a stream against prototypes, windowed counts, staged rounds by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vexilar.operators.prototypes import nearest_of


def score_stream(stream: DataFrame, protos: DataFrame) -> DataFrame:
    """The stream (id, v) with pred and score of the nearest prototype: stateless, one matrix product a batch.

    The rows are those of ``prototypes.predict``; prototypes are worked out once and checked for their number.
    """
    best = nearest_of(protos)
    found = stream.withColumn("_b", best("v"))
    return found.select(*stream.columns, F.col("_b.pred").alias("pred"), F.when(F.col("_b.pred").isNotNull(), 1 - F.col("_b.sim")).alias("score"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone: that of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums by event type; rows later than the watermark are left out in a stream."""
    out = _timed(events, late)
    return out.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user with gaps below ``gap`` as sessions."""
    out = _timed(events, late)
    return out.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def staged_rounds(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is a round: step(batch, round number) reads and writes the state tables, once for each batch."""
    return stream.writeStream.foreachBatch(lambda batch, n: step(batch, n)).option("checkpointLocation", checkpoint)
