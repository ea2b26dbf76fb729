"""Ticks to bars. Bars are keyed by (symbol, i), i the place in the symbol's time order from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Minutes of the timeframes.
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440}


def minutes(timeframe: str) -> int:
    """Minutes of a timeframe; 15 for an unknown one."""
    return TIMEFRAMES.get(timeframe.upper(), 15)


def numbered(bars: DataFrame) -> DataFrame:
    """Adds i. A symbol's bars are few next to its ticks: one for each interval of time."""
    return bars.withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("timestamp")).cast("long") - 1)


def bars(ticks: DataFrame, symbol: Column, time: Column, price: Column, tie: Column, interval: str = "1 hour") -> DataFrame:
    """symbol, i, timestamp, open, high, low, close, volume (ticks) of each interval that has ticks.

    Ticks are aggregated before the shuffle, so a symbol with most of the ticks costs no more than others. Ticks without time, symbol or price are left out."""
    t = ticks.select(symbol.alias("symbol"), time.cast("timestamp").alias("t"), price.cast("double").alias("p"), tie.alias("tie")).filter("symbol is not null and t is not null and p is not null and not isnan(p)")
    at = F.struct("t", "tie")
    out = t.groupBy("symbol", F.window("t", interval).alias("w")).agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return numbered(out.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")).select("symbol", "i", "timestamp", "open", "high", "low", "close", "volume")


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "1 hour") -> DataFrame:
    """Bars of the table events: a symbol for each event type, value as price."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), interval)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the table orders, over total prices."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars(o, F.lit("orders"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "1 day")
