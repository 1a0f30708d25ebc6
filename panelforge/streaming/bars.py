"""Bars of an event stream. The batch engine needs no stream; this extension feeds it from one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, period: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows (date, asset, open, high, low, close, volume) by event time; events later than `late` are left out.

    events: ts, asset, price, quantity, and id to order events of one instant. Works on streams and tables alike.
    """
    at = F.struct("ts", "id")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    bars = rows.groupBy(F.window("ts", period).alias("w"), "asset").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
    return bars.select(F.col("w.start").alias("date"), "asset", "open", "high", "low", "close", "volume")
