"""Price-gap zones: three-bar gaps, their mitigation, their inversion, the distance to the nearest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import lagged, over
from .intervals import first_after


def _touches(low: str, high: str) -> Column:
    return (F.col(low) <= F.col("top")) & (F.col(high) >= F.col("bottom"))


def _bars(df: DataFrame) -> DataFrame:
    return df.select("symbol", "i", "high", "low", "close")


def gaps(df: DataFrame, min_gap_atr: float = 0.25) -> DataFrame:
    """Child frame (symbol, type, top, bottom, created_i): a bar that leaves a gap to the bar before last, of min_gap_atr times ATR at least
    (any gap while ATR is null). df: with atr. One bar makes one gap at most."""
    h, lo, h2, l2 = F.col("high"), F.col("low"), lagged(F.col("high"), 2), lagged(F.col("low"), 2)
    df = over(df.select("symbol", "i", "atr", "high", "low"), 2, lambda d: d.withColumns({"h": h, "l": lo, "h2": h2, "l2": l2})).filter("h is not null and l is not null and h2 is not null and l2 is not null")
    df = df.withColumn("type", F.expr("case when h2 < l then 'bullish' when l2 > h then 'bearish' end")).filter("type is not null")
    df = df.withColumns({"top": F.expr("if(type = 'bullish', l, l2)"), "bottom": F.expr("if(type = 'bullish', h2, h)")})
    return df.filter(F.col("top") - F.col("bottom") >= F.coalesce(F.col("atr") * min_gap_atr, F.lit(0.0))).select("symbol", "type", "top", "bottom", F.col("i").alias("created_i"))


def mitigated(zones: DataFrame, df: DataFrame, key: list[str]) -> DataFrame:
    """Adds mitigated_i: the first bar after a zone's creation whose range meets it. It looks ahead: compare it with a bar's i."""
    return first_after(zones, _bars(df), key, F.col("created_i"), _touches("low", "high"), _touches("bin_low", "bin_high"), "mitigated_i")


def inverted(zones: DataFrame, df: DataFrame) -> DataFrame:
    """Child frame (symbol, type, top, bottom, created_i, source_i): gaps that a later close goes through; they turn to the other side at that bar."""
    bull = F.col("type") == "bullish"
    hit = F.when(bull, F.col("close") < F.col("bottom")).otherwise(F.col("close") > F.col("top"))
    may = F.when(bull, F.col("bin_low") < F.col("bottom")).otherwise(F.col("bin_high") > F.col("top"))
    found = first_after(zones.select("symbol", "type", "top", "bottom", "created_i"), _bars(df), ["symbol", "created_i"], F.col("created_i"), hit, may, "_at").filter("_at is not null")
    return found.select("symbol", F.when(bull, "bearish").otherwise("bullish").alias("type"), "top", "bottom", F.col("_at").alias("created_i"), F.col("created_i").alias("source_i"))


def distance_to_nearest(df: DataFrame, zones: DataFrame, name: str) -> DataFrame:
    """Adds name: see distances()."""
    return df.join(distances(df, {name: zones}), ["symbol", "i"], "left")


def distances(df: DataFrame, zones: dict[str, DataFrame]) -> DataFrame:
    """(symbol, i) and, by name of each set of zones, the gap, in ATR, between close and the nearest zone of the set created so far (0 inside one; zones never end; null if there is
    none), of bars with an ATR above zero. df: with atr.

    The bars up to i are as many dyadic blocks as i + 1 has bits set; a zone stands in one block of each level. In a block zones and closes are put in one order by
    price: of the zones that begin at a close or below, the highest top is at the close or above (the close lies in a zone) or is the nearest one below;
    the next zone to begin is the nearest one above. So bars times levels rows are sorted, and no zone meets all later bars. All sets are looked up at once.
    """
    priced = df.filter("close is not null and atr > 0").select("symbol", "i", "close", "atr")
    levels = df.groupBy("symbol").agg(F.max("i").alias("_end"))
    all_zones = reduce(DataFrame.unionByName, [z.select("symbol", "top", "bottom", "created_i", F.lit(k).alias("set")) for k, z in enumerate(zones.values())])
    placed = all_zones.join(levels, "symbol").withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_end") + 1)).cast("int"))))
    none = F.lit(None).cast("double")
    placed = placed.select("symbol", "set", "level", F.expr("shiftright(created_i, level)").alias("block"), F.col("bottom").alias("price"), F.lit(0).alias("kind"), "top", "bottom", F.lit(None).cast("long").alias("i"), none.alias("atr"))
    bits = F.filter(F.sequence(F.lit(0), F.floor(F.log2(F.col("i") + 1)).cast("int")), lambda k: F.expr("i + 1").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    asked = priced.withColumn("level", F.explode(bits)).withColumn("set", F.explode(F.array(*[F.lit(k) for k in range(len(zones))])))
    asked = asked.select("symbol", "set", "level", (F.expr("shiftright(i + 1, level)") - 1).alias("block"), F.col("close").alias("price"), F.lit(1).alias("kind"), none.alias("top"), none.alias("bottom"), "i", "atr")
    by_price = W.partitionBy("symbol", "set", "level", "block").orderBy("price", "kind")
    met = placed.unionByName(asked).withColumns({"below": F.max("top").over(by_price.rowsBetween(W.unboundedPreceding, 0)), "above": F.min("bottom").over(by_price.rowsBetween(0, W.unboundedFollowing))})
    c, out = F.first("price"), []
    for k, name in enumerate(zones):
        below, above = (f(F.when(F.col("set") == k, F.col(v))) for f, v in ((F.max, "below"), (F.min, "above")))
        out.append((F.when(below >= c, 0.0).otherwise(F.least(c - below, above - c)) / F.first("atr")).alias(name))
    return met.filter("kind = 1").groupBy("symbol", "i").agg(*out)
