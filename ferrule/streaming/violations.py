"""Class counts of a dependency over a stream: the state is what `fd_measures` needs, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(events: DataFrame, lhs: Sequence[str], rhs: str, time: str, late: str, window: str) -> DataFrame:
    """(window, lhs..., rhs, n) by event-time windows; rows later than the watermark are dropped."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), *lhs, rhs).agg(F.count("*").alias("n"))


def confidence(counts: DataFrame, lhs: Sequence[str]) -> DataFrame:
    """(window, support, hits, confidence) of a batch of class counts, as a sink's foreachBatch gets them."""
    by = counts.groupBy("window", *lhs).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    out = by.groupBy("window").agg(F.sum("n").alias("support"), F.sum("most").alias("hits"))
    return out.withColumn("confidence", F.col("hits") / F.col("support"))
