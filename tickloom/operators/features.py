"""The feature matrix: all features of a bar in one row, in a fixed order, and a flag for bars that lack any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.candles import patterns, sessions
from ..functions.series import flag, halo, lagged, own
from ..staging import kept
from . import indicators as ind
from . import signals as sig
from . import structure as st
from . import zones as z

#: The matrix's columns in order; of {p} and {s} there is one for each window of returns, of averages.
COLUMNS = (
    ("ret_{p}", "logret_{p}"), ("volatility",), ("ema_{s}_dist",), ("rsi", "macd", "macd_signal", "macd_hist", "atr", "bb_pctb", "bb_bandwidth", "channel_pos"),
    ("body_ratio", "upper_wick_ratio", "lower_wick_ratio", "candle_range", "is_doji", "is_hammer", "is_shooting_star", "is_bullish_engulfing", "is_bearish_engulfing"),
    ("ms_bias", "ms_bos", "ms_choch", "bars_since_bos", "bars_since_choch", "in_killzone", "pd_position", "premium"),
    ("buyside_sweep", "sellside_sweep", "dist_to_buyside", "dist_to_sellside", "dist_to_fvg", "dist_to_ifvg", "is_in_ifvg_retest", "signal_dir", "entry_is_primary"),
)
#: The columns that come again with lags, at the end.
LAGGED = ("ret_1", "rsi", "macd_hist", "ms_bias", "atr")


def feature_names(cfg: Config) -> list[str]:
    windows = {"{p}": cfg.features.return_windows, "{s}": cfg.features.ema_windows}
    out: dict[str, None] = {}
    for group in COLUMNS:
        mark = next((m for m in windows if m in group[0]), None)
        for w in windows.get(mark, [""]):
            out |= dict.fromkeys(c.replace(mark, str(w)) if mark else c for c in group)
    return [*out, *(f"{c}_lag{k}" for c in LAGGED if c in out for k in dict.fromkeys(cfg.features.return_windows))]


def base(bars: DataFrame, cfg: Config) -> DataFrame:
    """Bars with atr and market_structure(): what zones, signals and labels stand on, many times over, so it is kept."""
    return kept(st.market_structure(ind.atr(bars, cfg.features.atr_window), cfg.features.ict.swing_lookback))


def with_signals(df: DataFrame, cfg: Config) -> tuple[DataFrame, dict[str, DataFrame]]:
    """df with signals, and the zones, all kept."""
    found = sig.all_zones(df, cfg, kept)
    return kept(sig.signals(df, cfg, found)), found


def feature_matrix(df: DataFrame, cfg: Config, zones: dict[str, DataFrame]) -> DataFrame:
    """symbol, i, timestamp, close, feature_names() as doubles, warmup. df: base() with signals."""
    f, ict = cfg.features, cfg.features.ict
    names, bars = feature_names(cfg), df
    if "ret_1" not in names:
        df = df.withColumn("ret_1", F.lit(None).cast("double"))
    df = ind.oscillators(df, f.ema_windows, f.rsi_window, f.macd_fast, f.macd_slow, f.macd_signal)
    # all windows that follow share one halo: those of lags begin where those of returns do
    df = halo(df, max(f.bb_window, ict.liquidity_lookback, *f.return_windows) + max(f.return_windows, default=0))
    df = ind.channel(ind.bollinger(ind.volatility(ind.returns(df, f.return_windows), f.bb_window), f.bb_window, f.bb_std), f.bb_window)
    df = st.premium_discount(st.liquidity(df, ict.liquidity_lookback, ict.equal_level_tol_atr), ict.liquidity_lookback)
    df = df.withColumns(patterns() | {"in_killzone": sessions(ict.killzones)["in_killzone"]})
    c, atr = F.col("close"), F.when(F.col("atr") > 0, F.col("atr"))
    away = lambda level: F.try_divide(c - F.col(level), atr)
    more: dict[str, Column] = {f"ema_{s}_dist": F.try_divide(c - F.col(f"ema_{s}"), F.col(f"ema_{s}")) for s in f.ema_windows}
    more |= {"dist_to_buyside": away("buyside_level"), "dist_to_sellside": away("sellside_level")}
    taken = F.col("direction") != "none"
    more |= {
        "is_in_ifvg_retest": flag(taken & (F.col("entry_type") == "ifvg")),
        "signal_dir": F.when(F.col("direction") == "long", 1.0).when(F.col("direction") == "short", -1.0).otherwise(0.0),
        "entry_is_primary": flag(taken & (F.col("entry_type") == ict.primary_entry)),
    }
    df = df.withColumns(more)
    df = own(df.withColumns({f"{s}_lag{k}": lagged(F.col(s).cast("double"), k) for s in LAGGED for k in f.return_windows}))
    near = {"dist_to_fvg": zones["fvg"]} | ({"dist_to_ifvg": zones["ifvg"]} if ict.ifvg_enabled else {})
    df = df.join(z.distances(bars, near), ["symbol", "i"], "left")
    if not ict.ifvg_enabled:
        df = df.withColumn("dist_to_ifvg", F.lit(None).cast("double"))
    lacks = F.lit(False)
    for n in names:
        lacks = lacks | F.col(n).isNull()
    return df.select("symbol", "i", "timestamp", "close", *[F.col(n).cast("double").alias(n) for n in names], lacks.alias("warmup"))


def row(matrix: DataFrame, symbol: str, i: int) -> DataFrame:
    """The features of one bar; no row if there is no such bar."""
    return matrix.filter((F.col("symbol") == symbol) & (F.col("i") == i))


def vector(names: list[str]) -> Column:
    """The features in order, null and NaN as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names])
