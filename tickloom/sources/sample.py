"""Made-up bars for trying things out, in DataFrame operations only: every draw is a hash of (seed, symbol, bar, step), so rows are the same however they
are dealt out, and any number of symbols is made in parallel.

A bar is STEPS steps of a random walk of the log price. Volatility is one draw for each REGIME bars; every CYCLE bars the walk is bent back to where it began.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import minutes

STEPS, REGIME, CYCLE, STEP_VOLATILITY = 8, 40, 400, 0.0008


def _uniform(*key: Column) -> Column:
    """In (0, 1), by hash."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(*key: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(*key, F.lit("r")))) * F.cos(2 * math.pi * _uniform(*key, F.lit("a")))


def sample_bars(spark: SparkSession, rows: int = 300, seed: int = 7, start_price: float = 2000.0, start_time: str = "2023-01-02T00:00:00", timeframe: str = "M15", symbol: str = "SAMPLE", symbols: int = 1) -> DataFrame:
    """Bars of symbols symbols: the first is called symbol, the others symbol_1 and so on. The first opens at start_price, and each bar opens where the one before closed."""
    name = F.concat(F.lit(symbol), F.when(F.col("s") > 0, F.concat(F.lit("_"), F.col("s"))).otherwise(""))
    df = spark.range(rows * symbols).select((F.col("id") / rows).cast("long").alias("s"), (F.col("id") % rows).alias("i")).withColumn("symbol", name)
    regime = F.exp(0.5 * _normal(F.lit(seed), F.col("s"), F.floor(F.col("i") / REGIME), F.lit("v")))
    moves = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda k: _normal(F.lit(seed), F.col("s"), F.col("i"), k))
    df = df.withColumn("vol", regime * STEP_VOLATILITY).withColumn("moves", moves)
    path = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: F.aggregate(F.slice("moves", 1, k), F.lit(0.0), lambda a, b: a + b) * F.col("vol"))
    df = df.withColumn("path", path).withColumn("move", F.element_at("path", -1))
    bars = W.partitionBy("symbol", F.floor(F.col("i") / CYCLE))
    whole = F.sum("move").over(bars) * ((F.col("i") % CYCLE + 1) / F.count(F.lit(1)).over(bars))
    df = df.withColumn("after", F.sum("move").over(bars.orderBy("i")) - whole).withColumn("before", F.coalesce(F.lag("after").over(W.partitionBy("symbol").orderBy("i")), F.lit(0.0)))
    price = lambda level: F.round(F.lit(start_price) * F.exp(level), 2)
    inside = F.transform("path", lambda x: F.col("before") + x)
    first, last = price(F.col("before")), price(F.col("after"))
    volume = F.round((200 + 1500 * _uniform(F.lit(seed), F.col("s"), F.col("i"), F.lit("n"))) * F.col("vol") / STEP_VOLATILITY, 2)
    time = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start_time))) + F.col("i") * (60 * minutes(timeframe)))
    return df.select("symbol", "i", time.alias("timestamp"), first.alias("open"), F.greatest(price(F.array_max(inside)), first, last).alias("high"), F.least(price(F.array_min(inside)), first, last).alias("low"), last.alias("close"), volume.alias("volume"))
