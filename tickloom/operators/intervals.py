"""Interval joins by bins of bars: each interval meets only the bins that it spans, on an equality of (symbol, bin), so no pair of a symbol's
intervals and bars is formed beyond those, and a symbol with most of the bars spreads over as many tasks as it has bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars of a bin, and of a wide bin: far searches rule out wide bins first.
BIN, WIDE = 128, 128 * 128


def binned(bars: DataFrame, width: int = BIN) -> DataFrame:
    return bars.withColumn("bin", F.floor(F.col("i") / width))


def summaries(bars: DataFrame, width: int = BIN) -> DataFrame:
    """symbol, bin, bin_low, bin_high: what a bin's bars reach, closes beyond their bar's range included."""
    return binned(bars, width).groupBy("symbol", "bin").agg(F.min(F.least("low", "close")).alias("bin_low"), F.max(F.greatest("high", "close")).alias("bin_high"))


def spread(zones: DataFrame, lo: Column, hi: Column, width: int = BIN) -> DataFrame:
    """A row for each bin that [lo, hi] spans, with _lo and _hi."""
    zones = zones.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    return zones.withColumn("bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))


def possible(zones: DataFrame, bars: DataFrame, lo: Column, hi: Column, may: Column) -> DataFrame:
    """spread(), without the bins that cannot hold what is looked for. Wide bins are ruled out before their bins are listed.

    may: over the zone's columns, bin_low and bin_high, whether a bin could hold it. bars: with high, low and close."""
    wide = spread(zones, lo, hi, WIDE).join(summaries(bars, WIDE), ["symbol", "bin"]).filter(may).drop("bin_low", "bin_high")
    first = F.greatest(F.col("_lo"), F.col("bin") * WIDE)
    last = F.least(F.col("_hi"), F.col("bin") * WIDE + WIDE - 1)
    near = wide.withColumn("bin", F.explode(F.sequence(F.floor(first / BIN), F.floor(last / BIN))))
    return near.join(summaries(bars), ["symbol", "bin"]).filter(may).drop("bin_low", "bin_high")


def matches(zones: DataFrame, bars: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """zones with each bar (its columns but symbol) in [lo, hi]."""
    return spread(zones, lo, hi).join(binned(bars), ["symbol", "bin"]).filter(F.col("i").between(F.col("_lo"), F.col("_hi"))).drop("bin", "_lo", "_hi")


def first_after(zones: DataFrame, bars: DataFrame, key: list[str], start: Column, hit: Column, may: Column, name: str) -> DataFrame:
    """zones with name: the first bar after start where hit holds (null if none). key: the columns that tell zones apart.

    hit is over the zone's columns and a bar's high, low and close; may over those and bin_low and bin_high: whether a bin could hold such a bar.
    The two bins after the start are searched first; only zones that found nothing go on to the later bins that may hold a bar."""
    begin = start + 1
    near = matches(zones, bars, begin, (F.floor(begin / BIN) + 2) * BIN - 1).filter(hit).groupBy(*key).agg(F.min("i").alias(name))
    zones = zones.join(near, key, "left")
    ends = bars.groupBy("symbol").agg(F.max("i").alias("_end"))
    rest = zones.filter(F.col(name).isNull()).drop(name).join(ends, "symbol")
    later = possible(rest, bars, (F.floor(begin / BIN) + 2) * BIN, F.col("_end"), may)
    far = later.join(binned(bars), ["symbol", "bin"]).filter(hit).groupBy(*key).agg(F.min("i").alias("_far"))
    return zones.join(far, key, "left").withColumn(name, F.coalesce(name, "_far")).drop("_far")
