"""Sizes, costs and the drawdown guard, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ounces of a lot.
CONTRACT = 100.0


def cap_lots(lots: Column, most: Column) -> Column:
    return F.when(lots <= 0, 0.0).otherwise(F.least(lots, most))


def position_size(capital: Column, risk: Column, stop: Column, most: Column) -> Column:
    """Lots that lose the share risk of capital at the stop, most at the most; 0 if any of them is not above 0."""
    sound = (capital > 0) & (risk > 0) & (stop > 0)
    return F.when(F.coalesce(sound, F.lit(False)), cap_lots(risk * capital / F.when(stop > 0, stop * CONTRACT), most)).otherwise(0.0)


def net_pnl(gross: Column, spread: Column, commission: Column, lots: Column) -> Column:
    """Gross less the spread and the commission of the lots."""
    n = F.greatest(lots, F.lit(0.0))
    return gross - spread * CONTRACT * n - commission * n


def drawdown(equity: Column, peak: Column) -> Column:
    return F.when(peak > 0, (peak - equity) / F.when(peak > 0, peak)).otherwise(0.0)


def breached(equity: Column, peak: Column, limit: float) -> Column:
    return (peak > 0) & (drawdown(equity, peak) >= limit)
