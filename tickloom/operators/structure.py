"""Market structure: swings, breaks, bias; order blocks, liquidity, premium and discount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import blocked, lagged, over, rows_between
from .scan import carried


@blocked(lambda lookback=5: 2 * max(lookback, 0))
def swing_points(df: DataFrame, lookback: int = 5) -> DataFrame:
    """swing_high, swing_low: the price of a swing at the bar that confirms it (lookback bars later), and swing_high_i, swing_low_i: its own bar.

    A swing's price is beaten or met by none of the lookback bars on either side; a null high or low among them leaves no swing."""
    if lookback <= 0:
        return df.withColumns({n: F.lit(None).cast(t) for n, t in (("swing_high", "double"), ("swing_low", "double"), ("swing_high_i", "long"), ("swing_low_i", "long"))})
    past, ahead = rows_between(-lookback, -1), rows_between(1, lookback)
    h, lo = F.col("high"), F.col("low")
    whole = F.count(F.when(h.isNotNull() & lo.isNotNull(), 1)).over(rows_between(-lookback, lookback)) == 2 * lookback + 1
    top = whole & (h > F.max(h).over(past)) & (h > F.max(h).over(ahead))
    bottom = whole & (lo < F.min(lo).over(past)) & (lo < F.min(lo).over(ahead))
    df = df.withColumns({"_top": F.when(top, h), "_bottom": F.when(bottom, lo)})
    df = df.withColumns({"swing_high": lagged(F.col("_top"), lookback), "swing_low": lagged(F.col("_bottom"), lookback)})
    own = F.col("i") - lookback
    return df.withColumns({"swing_high_i": F.when(F.col("swing_high").isNotNull(), own), "swing_low_i": F.when(F.col("swing_low").isNotNull(), own)}).drop("_top", "_bottom")


def market_structure(df: DataFrame, lookback: int = 5) -> DataFrame:
    """Swings, and ms_bias, ms_bos, ms_choch (-1, 0, 1), bars_since_bos, bars_since_choch, last_swing_high, last_swing_low.

    A break is a close beyond the last swing of its side, tested when the next one is confirmed. The bias is the side of the last break, so a break against it
    changes the character and one with it continues the structure; on a bar with both, the upward one comes first."""
    plain = df.columns
    i, c = F.col("i"), F.col("close")
    df = carried(swing_points(df, lookback), {"_sh": ("last", F.col("swing_high"), -1), "_sl": ("last", F.col("swing_low"), -1)})
    up = F.coalesce(F.col("swing_high").isNotNull() & (c > F.col("_sh")), F.lit(False))
    down = F.coalesce(F.col("swing_low").isNotNull() & (c < F.col("_sl")), F.lit(False))
    df = df.withColumns({"_up": up, "_down": down, "last_swing_high": F.coalesce("swing_high", "_sh"), "last_swing_low": F.coalesce("swing_low", "_sl")})
    side, broken = F.when(F.col("_down"), -1).when(F.col("_up"), 1), F.col("_up") | F.col("_down")  # every break continues or changes
    df = carried(df.withColumn("_side", side), {"_was": ("last", F.col("_side"), -1), "_broke": ("last", F.when(broken, i), 0)})
    df = df.withColumn("_was", F.coalesce("_was", F.lit(0))).withColumn("ms_bias", F.coalesce("_side", "_was"))
    mid = F.when(F.col("_up"), 1).otherwise(F.col("_was"))
    bos = F.when(F.col("_down") & (mid < 0), -1).when(F.col("_up") & (F.col("_was") > 0), 1).otherwise(0)
    choch = F.when(F.col("_down") & (mid >= 0), -1).when(F.col("_up") & (F.col("_was") <= 0), 1).otherwise(0)
    df = carried(df.withColumns({"ms_bos": bos, "ms_choch": choch}), {"_changed": ("last", F.when(F.col("ms_choch") != 0, i), 0)})
    df = df.withColumns({"bars_since_bos": i - F.col("_broke"), "bars_since_choch": i - F.col("_changed")})
    return df.select(*plain, "swing_high", "swing_low", "swing_high_i", "swing_low_i", "ms_bias", "ms_bos", "ms_choch", "bars_since_bos", "bars_since_choch", "last_swing_high", "last_swing_low")


def order_blocks(df: DataFrame, lookback: int = 20) -> DataFrame:
    """Child frame (symbol, type, top, bottom, created_i, source_i): of each break of structure, the last candle against it among the lookback bars before. df: with market_structure()."""
    o, c = F.col("open"), F.col("close")
    candle = F.struct("i", "high", "low")
    last = lambda against: F.max(F.when(against, candle)).over(rows_between(-lookback, -1))
    df = over(df, lookback, lambda d: d.withColumns({"_down": last(c < o), "_up": last(c > o)})).filter("ms_bos != 0")
    df = df.withColumn("_ob", F.when(F.col("ms_bos") > 0, F.col("_down")).otherwise(F.col("_up"))).filter("_ob is not null")
    kind = F.when(F.col("ms_bos") > 0, "bullish").otherwise("bearish")
    return df.select("symbol", kind.alias("type"), F.col("_ob.high").alias("top"), F.col("_ob.low").alias("bottom"), F.col("i").alias("created_i"), F.col("_ob.i").alias("source_i"))


@blocked(lambda lookback=50, tolerance=0.1: lookback)
def liquidity(df: DataFrame, lookback: int = 50, tolerance: float = 0.1) -> DataFrame:
    """buyside_level, sellside_level, buyside_sweep, sellside_sweep. df: with swing_points() and atr.

    A level is the mean of the swings confirmed in the last lookback bars that lie within tolerance times ATR of the newest one; without ATR it is the newest one,
    and nothing sweeps it."""
    tol = F.when(F.col("atr") != 0, F.col("atr") * tolerance)
    out = df
    for side, swing in (("buyside", "swing_high"), ("sellside", "swing_low")):
        recent = F.collect_list(swing).over(rows_between(-lookback, 0))
        out = out.withColumn("_recent", recent).withColumn("_newest", F.try_element_at("_recent", F.lit(-1))).withColumn("_tol", tol)
        near = F.filter("_recent", lambda p: F.abs(p - F.col("_newest")) <= F.col("_tol"))
        mean = F.aggregate(near, F.lit(0.0), lambda a, p: a + p) / F.size(near)
        out = out.withColumn(f"{side}_level", F.when(F.col("_newest").isNull() | F.col("_tol").isNull() | (F.col("_tol") <= 0), F.col("_newest")).otherwise(mean))
        level, c = F.col(f"{side}_level"), F.col("close")
        swept = (F.col("high") > level) & (c < level) if side == "buyside" else (F.col("low") < level) & (c > level)
        out = out.withColumn(f"{side}_sweep", F.when(level.isNotNull(), F.coalesce(F.col("_tol").isNotNull() & swept, F.lit(False))))
    return out.drop("_recent", "_newest", "_tol")


@blocked(lambda window=50: window - 1)
def premium_discount(df: DataFrame, window: int = 50) -> DataFrame:
    """pd_position of the close in the range of the last window bars (nulls passed over), and premium: above its middle."""
    frame = rows_between(1 - window, 0)
    hi, lo = F.max("high").over(frame), F.min("low").over(frame)
    df = df.withColumns({"_hi": hi, "_lo": lo})
    span = F.col("_hi") - F.col("_lo")
    df = df.withColumn("pd_position", F.when((F.col("i") >= window - 1) & (span > 0), (F.col("close") - F.col("_lo")) / span))
    return df.withColumn("premium", F.col("pd_position") > 0.5).drop("_hi", "_lo")
