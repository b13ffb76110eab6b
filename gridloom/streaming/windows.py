"""Windows over event streams. They work alike on a batch and on a stream (give ``late`` on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """``start, keys, n, total``"""
    df = events.withWatermark("ts", late) if late else events
    g = df.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """``start, end, keys, n``: runs of events with less than ``gap`` between them."""
    df = events.withWatermark("ts", late) if late else events
    g = df.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
