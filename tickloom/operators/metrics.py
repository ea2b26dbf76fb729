"""Performance metrics of an equity curve and its trades."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import blocked, lagged
from .scan import carried

#: 15-minute bars of 252 days, and seconds of a year.
BARS_PER_YEAR, YEAR_S = 4 * 24 * 252, 365.25 * 24 * 3600


@blocked(lambda: 1)
def bar_returns(curve: DataFrame) -> DataFrame:
    """Adds ret: the equity's change from the bar before, 0 where that is 0; null on the first bar."""
    before = lagged(F.col("equity"), 1)
    return curve.withColumn("ret", F.when(before == 0, 0.0).otherwise(F.try_divide(F.col("equity") - before, before)))


def drawdowns(curve: DataFrame) -> DataFrame:
    """Adds peak, peak_i (its first bar) and dd, the share lost since."""
    rows = carried(curve, {"_top": ("max", F.struct(F.col("equity").alias("equity"), (-F.col("i")).alias("at")), 0)})
    rows = rows.withColumns({"peak": F.col("_top.equity"), "peak_i": -F.col("_top.at")}).drop("_top")
    return rows.withColumn("dd", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.when(F.col("peak") > 0, F.col("peak"))).otherwise(0.0))


def metrics(curve: DataFrame, trades: DataFrame, summary: DataFrame, bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """One row a symbol with the fifteen metrics. Empty logs give zeros, not errors."""
    r = bar_returns(curve).groupBy("symbol").agg(F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_std"), F.count("ret").alias("_n"), F.min("timestamp").alias("_t0"), F.max("timestamp").alias("_t1"))
    d = drawdowns(curve).groupBy("symbol").agg(F.max(F.struct("dd", (-F.col("i")).alias("at"), (F.col("i") - F.col("peak_i")).alias("bars"))).alias("_dd"))
    win, loss = F.when(F.col("net_pnl") > 0, F.col("net_pnl")), F.when(F.col("net_pnl") < 0, F.col("net_pnl"))
    t = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("num_trades"), F.count(win).alias("_wins"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.sum(win).alias("_profit"), (-F.sum(loss)).alias("_lost"))
    m = summary.join(r, "symbol", "left").join(d, "symbol", "left").join(t, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first, final = F.col("initial_capital"), F.col("final_equity")
    years = (F.unix_micros("_t1") - F.unix_micros("_t0")) / 1e6 / YEAR_S
    power = F.pow(final / first, F.try_divide(F.lit(1.0), years)) - 1
    return m.select(
        "symbol", "initial_capital", "final_equity", zero(F.when(first > 0, final / first - 1)).alias("total_return"), zero(F.when((first > 0) & (final > 0) & (years > 0), power)).alias("cagr"),
        zero(F.when((F.col("_n") >= 2) & (F.col("_std") > 0), F.col("_mean") / F.col("_std") * math.sqrt(bars_per_year))).alias("sharpe"), F.lit(bars_per_year).alias("bars_per_year"),
        zero(F.greatest("_dd.dd", F.lit(0.0))).alias("max_drawdown"), F.when(F.col("_dd.dd") > 0, F.col("_dd.bars")).otherwise(0).cast("long").alias("max_drawdown_duration"),
        zero(F.try_divide(F.col("_wins"), F.col("num_trades"))).alias("win_rate"), zero(F.col("avg_win")).alias("avg_win"), zero(F.col("avg_loss")).alias("avg_loss"),
        F.when(F.col("_lost") > 0, zero(F.col("_profit")) / F.col("_lost")).when(F.col("_profit") > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
        F.coalesce("num_trades", F.lit(0)).cast("long").alias("num_trades"), zero(F.try_divide(F.col("bars_in_market"), F.col("total_bars"))).alias("exposure"), "halted",
    )


def report(m: dict) -> str:
    """The metrics of one symbol as text, a line each."""
    kinds = {"%": ("total_return", "cagr", "max_drawdown", "win_rate", "exposure"), "d": ("num_trades", "max_drawdown_duration", "bars_per_year")}
    told = lambda name, x: f"{x:.2%}" if name in kinds["%"] else f"{x:d}" if name in kinds["d"] else f"{x:.2f}" if isinstance(x, float) else str(x)
    return "\n".join(f"{name.replace('_', ' ')}: {told(name, value)}" for name, value in m.items())
