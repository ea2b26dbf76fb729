"""Predicates and ratios of single bars and of a bar with the one before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .series import lagged

#: A doji's body is at most this share of its range; a hammer's wick at least this multiple of its body.
DOJI_BODY, WICK_TIMES = 0.1, 2.0
#: UTC hours of the sessions, end exclusive.
SESSIONS = {"asia": (0, 3), "london": (7, 10), "newyork_am": (12, 15), "newyork_pm": (17, 20)}


def _c(name: str) -> Column:
    return F.col(name)


def _whole(*prices: Column) -> Column:
    ok = prices[0].isNotNull()
    for p in prices[1:]:
        ok = ok & p.isNotNull()
    return ok


def patterns() -> dict[str, Column]:
    """The nine pattern columns by name, in their fixed order. A null price in a bar it looks at makes a pattern null; so does a range of zero, for ratios and the doji."""
    o, h, lo, c = _c("open"), _c("high"), _c("low"), _c("close")
    po, ph, pl, pc = (lagged(x, 1) for x in (o, h, lo, c))
    span, body, upper, lower = h - lo, F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - lo
    known, both = _whole(o, h, lo, c), _whole(o, h, lo, c, po, ph, pl, pc)
    ranged = known & (span > 0)
    return {
        "body_ratio": F.when(ranged, body / span),
        "upper_wick_ratio": F.when(ranged, upper / span),
        "lower_wick_ratio": F.when(ranged, lower / span),
        "candle_range": F.when(known, span),
        "is_doji": F.when(ranged, body <= DOJI_BODY * span),
        "is_hammer": F.when(known, (body > 0) & (lower >= WICK_TIMES * body) & (upper <= body)),
        "is_shooting_star": F.when(known, (body > 0) & (upper >= WICK_TIMES * body) & (lower <= body)),
        "is_bullish_engulfing": F.when(both, (pc < po) & (c > o) & (c >= po) & (o <= pc)),
        "is_bearish_engulfing": F.when(both, (pc > po) & (c < o) & (o >= pc) & (c <= po)),
    }


def sessions(zones: tuple[str, ...]) -> dict[str, Column]:
    """in_<zone> for each zone and in_killzone for any of them; an unknown zone is never on; a null time gives null."""
    hour = F.hour("timestamp")
    known = hour.isNotNull()
    each = {f"in_{z}": F.when(known, (hour >= SESSIONS[z][0]) & (hour < SESSIONS[z][1]) if z in SESSIONS else F.lit(False)) for z in zones}
    any_ = F.lit(False)
    for flag in each.values():
        any_ = any_ | F.coalesce(flag, F.lit(False))
    return each | {"in_killzone": F.when(known, any_)}
