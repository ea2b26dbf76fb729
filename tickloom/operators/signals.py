"""Entry signals: bars that come back to a zone on the side of the bias."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import zones as z
from .intervals import binned, matches, possible
from .structure import order_blocks

TRIGGERS = ("ifvg", "fvg", "order_block")


def trigger_order(primary: str, ifvg_enabled: bool) -> list[str]:
    """The primary trigger, then the others in their fixed order; the first one stands in for an unknown primary."""
    known = [t for t in TRIGGERS if ifvg_enabled or t != "ifvg"]
    first = primary if primary in known else known[0]
    return [first, *(t for t in known if t != first)]


def _hits(pairs: DataFrame, order: str, trigger: str) -> DataFrame:
    """Of each bar the first zone by order that its range, widened by the tolerance, meets on the side of the bias."""
    near = (F.col("low") - F.col("tol") <= F.col("top")) & (F.col("high") + F.col("tol") >= F.col("bottom"))
    side = ((F.col("type") == "bullish") & (F.col("ms_bias") >= 0)) | ((F.col("type") == "bearish") & (F.col("ms_bias") <= 0))
    zone = F.struct(F.when(F.col("type") == "bullish", "long").otherwise("short").alias("direction"), F.lit(trigger).alias("entry_type"), "top", "bottom")
    return pairs.filter(near & side).groupBy("symbol", "i").agg(F.min_by(zone, order).alias(f"hit_{trigger}"))


def _block_hits(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Order blocks never end: bins whose widened range does not meet a block are passed over before their bars are."""
    ends = bars.groupBy("symbol").agg(F.max("i").alias("_end"))
    reach = bars.select("symbol", "i", (F.col("low") - F.col("tol")).alias("low"), (F.col("high") + F.col("tol")).alias("high"), F.lit(None).cast("double").alias("close"))
    open_ = blocks.filter("top is not null and bottom is not null").join(ends, "symbol")
    wide = possible(open_, reach, F.col("created_i") + 1, F.col("_end"), (F.col("bin_low") <= F.col("top")) & (F.col("bin_high") >= F.col("bottom"))).drop("_end")
    return _hits(wide.join(binned(bars), ["symbol", "bin"]).filter("i between _lo and _hi"), "created_i", "order_block")


def all_zones(df: DataFrame, cfg: Config, keep: Callable[[DataFrame], DataFrame] = lambda zones: zones) -> dict[str, DataFrame]:
    """fvg and ifvg (with source_i and mitigated_i) and order_block. df: with atr and market_structure(). keep: what is done with each frame, to write it for one."""
    ict = cfg.features.ict
    gaps = keep(z.gaps(df, ict.fvg_min_gap_atr))
    ifvg = keep(z.inverted(gaps, df))
    return {
        "fvg": keep(z.mitigated(gaps.withColumn("source_i", F.col("created_i")), df, ["symbol", "created_i"])),
        "ifvg": keep(z.mitigated(ifvg, df, ["symbol", "source_i"])),
        "order_block": keep(order_blocks(df, ict.order_block_lookback)),
    }


def signals(df: DataFrame, cfg: Config, zones: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds direction (long, short, none), entry_type, entry_price, stop_dist, target_dist, zone_top, zone_bottom.

    A bar with an ATR above zero takes the first trigger in order that hits; of its zones that were there before the bar and that no bar in between met, the one from the
    oldest source. df: with atr and market_structure()."""
    ict, kept = cfg.features.ict, df.columns
    zones = zones or all_zones(df, cfg)
    bars = df.filter("atr > 0 and high is not null and low is not null").select("symbol", "i", "high", "low", "ms_bias", (F.col("atr") * ict.ifvg_retest_atr_tol).alias("tol"))
    ends = df.groupBy("symbol").agg(F.max("i").alias("_end"))
    found = []
    for t in trigger_order(ict.primary_entry, ict.ifvg_enabled):
        if t == "order_block":
            found.append(_block_hits(zones[t], bars))
        else:
            live = zones[t].join(ends, "symbol")
            found.append(_hits(matches(live, bars, F.col("created_i") + 1, F.coalesce("mitigated_i", "_end")), "source_i", t))
    names = [f"hit_{t}" for t in trigger_order(ict.primary_entry, ict.ifvg_enabled)]
    out = reduce(lambda a, b: a.join(b, ["symbol", "i"], "left"), found, df).withColumn("_hit", F.coalesce(*names)).drop(*names)
    hit = F.col("_hit").isNotNull()
    return out.select(
        *kept, F.coalesce("_hit.direction", F.lit("none")).alias("direction"), F.coalesce("_hit.entry_type", F.lit("none")).alias("entry_type"), F.col("close").alias("entry_price"),
        F.when(hit, F.col("atr") * cfg.labeling.stop_atr_mult).alias("stop_dist"), F.when(hit, F.col("atr") * cfg.labeling.target_atr_mult).alias("target_dist"),
        F.col("_hit.top").alias("zone_top"), F.col("_hit.bottom").alias("zone_bottom"),
    )
