"""Recordings of several records: cluster or predict on their means, and give the result back to every record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.functions.vectors import mean_by


def aggregate_recordings(df: DataFrame, views: list[str], recording: str = "recording_id") -> DataFrame:
    """(id, n, views): mean vector of each recording in each view; id is the recording's."""
    out = None
    for v in views:
        part = mean_by(df, [recording], v).withColumnRenamed("n", f"n_{v}")
        out = part if out is None else out.join(part, recording)
    return out.select(F.col(recording).alias("id"), F.col(f"n_{views[0]}").alias("n"), *views)


def propagate(df: DataFrame, labels: DataFrame, recording: str = "recording_id") -> DataFrame:
    """Records with the columns of their recording's row in ``labels`` (id, ...)."""
    return df.join(labels.withColumnRenamed("id", recording), recording)


def vote(df: DataFrame, pred: str = "pred", recording: str = "recording_id") -> DataFrame:
    """(recording, pred): the most frequent prediction, the smallest of equally frequent ones."""
    n = df.groupBy(recording, pred).agg(F.count("*").alias("n"))
    best = n.groupBy(recording).agg(F.max(F.struct("n", (-F.col(pred)).alias("neg"))).alias("b"))
    return best.select(recording, (-F.col("b.neg")).alias(pred))
