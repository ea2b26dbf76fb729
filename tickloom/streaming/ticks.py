"""Ticks to bars as a stream, with a watermark for late ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, symbol: Column, time: Column, price: Column, tie: Column, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of closed intervals (append mode): symbol, timestamp, open, high, low, close, volume. Ticks that come more than late behind the newest are dropped by the watermark."""
    t = ticks.select(symbol.alias("symbol"), time.cast("timestamp").alias("t"), price.cast("double").alias("p"), tie.alias("tie")).withWatermark("t", late)
    at = F.struct("t", "tie")
    out = t.groupBy("symbol", F.window("t", interval).alias("w")).agg(F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
