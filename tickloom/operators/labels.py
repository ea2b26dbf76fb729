"""Triple-barrier labels. They look ahead by design, and are never features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import matches


def side(direction: Column) -> Column:
    """1 for long, buy or a number above 0; -1 for short, sell or one below; else null."""
    text = F.lower(F.trim(direction.cast("string")))
    number = text.try_cast("double")
    return F.when(text.isin("long", "buy") | (number > 0), 1).when(text.isin("short", "sell") | (number < 0), -1)


def triple_barrier(df: DataFrame, target_mult: float = 2.0, stop_mult: float = 1.0, horizon: int = 24, direction: Column | None = None) -> DataFrame:
    """Adds label (1 target first, -1 stop first or both in one bar, 0 neither within the horizon) and horizon_used (bars until then).

    Entries are at the close. Null where ATR is null or not above 0, the close is null, there is no direction (None: all long), or the horizon runs beyond the last bar.
    df: with atr."""
    bars = df.select("symbol", "i", "high", "low").filter("high is not null and low is not null")
    ends = df.groupBy("symbol").agg(F.max("i").alias("_end"))
    entries = df.withColumn("side", side(direction) if direction is not None else F.lit(1)).join(ends, "symbol")
    entries = entries.filter((F.col("atr") > 0) & F.col("close").isNotNull() & F.col("side").isNotNull() & (F.col("i") + horizon <= F.col("_end")))
    entries = entries.select("symbol", F.col("i").alias("entry_i"), "side", (F.col("close") + F.col("side") * F.col("atr") * target_mult).alias("target"), (F.col("close") - F.col("side") * F.col("atr") * stop_mult).alias("stop"))
    long = F.col("side") > 0
    stopped = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    reached = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    touch = F.when(stopped, -1).when(reached, 1)
    ahead = matches(entries, bars, F.col("entry_i") + 1, F.col("entry_i") + horizon).withColumn("_touch", touch)
    first = ahead.groupBy("symbol", "entry_i").agg(F.min(F.when(F.col("_touch").isNotNull(), F.struct("i", "_touch"))).alias("_first"))
    known = entries.select("symbol", "entry_i").join(first, ["symbol", "entry_i"], "left").select(
        "symbol", F.col("entry_i").alias("i"), F.coalesce("_first._touch", F.lit(0)).alias("label"), F.coalesce(F.col("_first.i") - F.col("entry_i"), F.lit(horizon)).cast("int").alias("horizon_used")
    )
    return df.join(known, ["symbol", "i"], "left")
