"""Technical indicators. All are causal: a bar's value depends on bars up to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import blocked, lagged, log_change, over, pct_change, rolling_max, rolling_mean, rolling_min, rolling_std, rows_between, series
from .scan import smoothed


@blocked(lambda periods: max(periods, default=0))
def returns(df: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    c = F.col("close")
    return df.withColumns({k: v for p in periods for k, v in ((f"ret_{p}", pct_change(c, p)), (f"logret_{p}", log_change(c, p)))})


@blocked(lambda window=20, name='': window)
def volatility(df: DataFrame, window: int = 20, name: str = "volatility") -> DataFrame:
    return df.withColumn("_ret", pct_change(F.col("close"))).withColumn(name, rolling_std(F.col("_ret"), window)).drop("_ret")


@blocked(lambda window, name=None, of='': window - 1)
def sma(df: DataFrame, window: int, name: str | None = None, of: str = "close") -> DataFrame:
    return df.withColumn(name or f"sma_{window}", rolling_mean(F.col(of), window))


def ema(df: DataFrame, spans: tuple[int, ...], of: str = "close") -> DataFrame:
    return smoothed(df, ema_inputs(spans, of))


@blocked(lambda name="": 1)
def true_range(df: DataFrame, name: str = "tr") -> DataFrame:
    """The first bar's, and that after a null close, is its own range."""
    h, lo, before = F.col("high"), F.col("low"), lagged(F.col("close"), 1)
    own = h - lo
    return df.withColumn(name, F.when(own.isNotNull(), F.greatest(own, F.coalesce(F.abs(h - before), own), F.coalesce(F.abs(lo - before), own))))


def _seeded(x: Column, window: int) -> Column:
    """x from the seed's bar on; the seed is the mean of bars 1 to window."""
    seed = F.avg(x).over(rows_between(1 - window, 0))
    return F.when(F.col("i") > window, x).when(F.col("i") == window, seed)


def atr(df: DataFrame, window: int = 14, name: str = "atr") -> DataFrame:
    """Wilder's smoothing of the true range. A null range carries the value on; one within the seed makes the whole series a plain rolling mean."""
    plain, i = df.columns, F.col("i")

    def seeded(df: DataFrame) -> DataFrame:
        df = true_range(df, "_tr")
        full = F.count("_tr").over(rows_between(1 - window, 0)) == window
        df = df.withColumn("_lacks", F.when(i == window, (~full).cast("double"))).withColumn("_mean", rolling_mean(F.col("_tr"), window))
        return df.withColumn("_soon", F.lead("_lacks").over(series())).withColumn("_in", _seeded(F.col("_tr"), window))

    df = smoothed(over(df, window, seeded, 1), {"_atr": (F.col("_in"), 1.0 / window), "_gap": (F.col("_lacks"), 1.0)})
    plain_mean = (F.col("_gap") == 1) | ((i == window - 1) & (F.col("_soon") == 1))  # the bar before the seed's may have a mean too
    return df.withColumn(name, F.when(plain_mean, F.col("_mean")).when(i >= window, F.col("_atr"))).select(*plain, name)


def ema_inputs(spans: tuple[int, ...], of: str = "close") -> dict[str, tuple[Column, float]]:
    return {f"ema_{s}": (F.col(of), 2.0 / (s + 1.0)) for s in spans}


@blocked(lambda window=14: window)
def rsi_seeds(df: DataFrame, window: int = 14) -> DataFrame:
    """Adds _up and _down: what the averages of gains and losses are smoothed from. A null close makes its two changes zero."""
    df = df.withColumn("_d", F.coalesce(F.col("close") - lagged(F.col("close"), 1), F.lit(0.0)))
    return df.withColumns({"_up": _seeded(F.greatest(F.col("_d"), F.lit(0.0)), window), "_down": _seeded(F.greatest(-F.col("_d"), F.lit(0.0)), window)}).drop("_d")


def rsi_inputs(window: int = 14) -> dict[str, tuple[Column, float]]:
    return {"_gain": (F.col("_up"), 1.0 / window), "_loss": (F.col("_down"), 1.0 / window)}


def rsi_value(window: int = 14) -> Column:
    value = F.when(F.col("_loss") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(F.col("_gain"), F.col("_loss"))))
    return F.when(F.col("i") >= window, value)


def macd_inputs(fast: int = 12, slow: int = 26) -> dict[str, tuple[Column, float]]:
    return {"_fast": (F.col("close"), 2.0 / (fast + 1.0)), "_slow": (F.col("close"), 2.0 / (slow + 1.0))}


def macd_line(slow: int = 26) -> Column:
    return F.when(F.col("i") >= slow - 1, F.col("_fast") - F.col("_slow"))


def rsi(df: DataFrame, window: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder's RSI; 100 where there is no average loss."""
    return smoothed(rsi_seeds(df, window), rsi_inputs(window)).withColumn(name, rsi_value(window)).select(*df.columns, name)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (null before bar slow - 1), macd_signal (seeded there) and macd_hist."""
    return _with_signal(smoothed(df, macd_inputs(fast, slow)).withColumn("macd", macd_line(slow)), signal).select(*df.columns, "macd", "macd_signal", "macd_hist")


def _with_signal(df: DataFrame, signal: int) -> DataFrame:
    return smoothed(df, {"macd_signal": (F.col("macd"), 2.0 / (signal + 1.0))}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def oscillators(df: DataFrame, spans: tuple[int, ...], window: int, fast: int, slow: int, signal: int) -> DataFrame:
    """ema(), rsi() and macd() together: one scan for all that stands on closes, and one for the signal."""
    df_ = smoothed(rsi_seeds(df, window), ema_inputs(spans) | rsi_inputs(window) | macd_inputs(fast, slow))
    df_ = _with_signal(df_.withColumns({"rsi": rsi_value(window), "macd": macd_line(slow)}), signal)
    return df_.select(*df.columns, *[f"ema_{s}" for s in spans], "rsi", "macd", "macd_signal", "macd_hist")


@blocked(lambda window=20, width=2.0: window - 1)
def bollinger(df: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, bb_pctb (null if the bands meet), bb_bandwidth (null if the middle is zero)."""
    c = F.col("close")
    df = df.withColumns({"bb_mid": rolling_mean(c, window), "_sd": rolling_std(c, window, 0)})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + F.col("_sd") * width, "bb_lower": F.col("bb_mid") - F.col("_sd") * width})
    span = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_pctb": F.try_divide(c - F.col("bb_lower"), span), "bb_bandwidth": F.try_divide(span, F.col("bb_mid"))}).drop("_sd")


@blocked(lambda window=20: window - 1)
def channel(df: DataFrame, window: int = 20) -> DataFrame:
    """rolling_high, rolling_low, and channel_pos of the close between them (null unless they differ)."""
    df = df.withColumns({"rolling_high": rolling_max(F.col("high"), window), "rolling_low": rolling_min(F.col("low"), window)})
    span = F.col("rolling_high") - F.col("rolling_low")
    return df.withColumn("channel_pos", F.when(span > 0, (F.col("close") - F.col("rolling_low")) / span))
