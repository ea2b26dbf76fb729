"""Null-aware kernels over bars ordered by i within symbol. A window that is not full, or holds a null, gives null.

Windows are not over a symbol but over a block of its bars and a halo: copies of the bars before the block that its windows reach back to. So a symbol with most
of the bars spreads over as many tasks as it has blocks. i counts a symbol's bars without gaps. Kernels stand within over(), or in an operator that is blocked().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

#: Bars of a block, and the column that says which block (its own or the halo's) a row stands in.
WIDTH, HALO = 4096, "_halo"


def halo(df: DataFrame, back: int, ahead: int = 0) -> DataFrame:
    """df's rows by block, with the last back bars before each block, and the first ahead bars after it."""
    first = F.greatest(F.floor((F.col("i") - ahead) / WIDTH), F.lit(0).cast("long"))
    return df.withColumn(HALO, F.explode(F.sequence(first, F.floor((F.col("i") + back) / WIDTH))))


def own(df: DataFrame) -> DataFrame:
    """Without the halo's rows."""
    return df.filter(F.col(HALO) == F.floor(F.col("i") / WIDTH)).drop(HALO)


def over(df: DataFrame, back: int, run: Callable[[DataFrame], DataFrame], ahead: int = 0) -> DataFrame:
    """run(df), where windows reach so many bars back and ahead at most; within another over(), that one's halo serves."""
    return run(df) if HALO in df.columns else own(run(halo(df, back, ahead)))


def blocked(back: Callable[..., int]) -> Callable:
    """An operator on bars whose windows reach back so many bars (from its arguments after the bars): done over blocks."""

    def made(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(run)
        def within(df: DataFrame, *args, **kwargs) -> DataFrame:
            return over(df, back(*args, **kwargs), lambda part: run(part, *args, **kwargs))

        return within

    return made


def series() -> WindowSpec:
    return W.partitionBy("symbol", HALO).orderBy("i")


def rows_between(first: int, last: int) -> WindowSpec:
    return series().rowsBetween(first, last)


def to_number(c: Column) -> Column:
    """A double; null for what is no number, and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def _full(c: Column, w: int, value: Column) -> Column:
    return F.when(F.count(c).over(rows_between(1 - w, 0)) == w, value)


def _checked(w: int) -> int:
    if w <= 0:
        raise ValueError("a window needs one bar at least")
    return w


def rolling_mean(c: Column, w: int) -> Column:
    return _full(c, _checked(w), F.avg(c).over(rows_between(1 - w, 0)))


def rolling_std(c: Column, w: int, ddof: int = 1) -> Column:
    """Sample (ddof 1) or population (ddof 0) deviation; null where the window is too short for it."""
    if _checked(w) - ddof <= 0:
        return F.lit(None).cast("double")
    return _full(c, w, (F.stddev_samp(c) if ddof else F.stddev_pop(c)).over(rows_between(1 - w, 0)))


def rolling_max(c: Column, w: int) -> Column:
    return _full(c, _checked(w), F.max(c).over(rows_between(1 - w, 0)))


def rolling_min(c: Column, w: int) -> Column:
    return _full(c, _checked(w), F.min(c).over(rows_between(1 - w, 0)))


def lagged(c: Column, k: int) -> Column:
    return F.lag(c, k).over(series()) if k else c


def diff(c: Column, p: int = 1) -> Column:
    return c - lagged(c, _checked(p))


def pct_change(c: Column, p: int = 1) -> Column:
    """Null where the base is null or zero."""
    base = lagged(c, _checked(p))
    return F.try_divide(c - base, base)


def log_change(c: Column, p: int = 1) -> Column:
    base = lagged(c, _checked(p))
    return F.when((c > 0) & (base > 0), F.log(F.try_divide(c, base)))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def flag(c: Column) -> Column:
    """1.0, 0.0 or null."""
    return c.cast("double")
