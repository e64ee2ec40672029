"""Bars over streams of ticks, in event-time windows; a watermark says when a bar is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(market, start, open, high, low, close, volume) from (market, ts, seq, price); ticks later than ``late`` are not counted."""
    seen = ticks.withWatermark("ts", late)
    order = F.struct("ts", "seq")
    out = seen.groupBy("market", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return out.select("market", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")
