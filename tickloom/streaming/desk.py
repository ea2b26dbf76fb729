"""From ticks to fills as one stream: bars of closed intervals, the signals that they give, and the paper account that trades them.

What the batch finds with windows and interval joins is kept up bar by bar, one state a symbol: Wilder averages, the last bars, swings and the side of the last
break, and the zones that may still matter (gaps until they are both met and inverted, inverted gaps until they are met, order blocks for ever). A bar's signal stands on zones of bars before, so zones
are asked first and changed after. A symbol that falls silent is closed out by a timer in event time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators.signals import trigger_order
from .paper import FILL, Book, Position, known, opened, settled, step

Bar = dict


@dataclass
class Wilder:
    """An average that is seeded by the mean of its values 1 to window; value 0 and what comes before a whole seed do not count. A null carries it on."""

    window: int
    n: int = 0
    value: float | None = None
    seed: list = field(default_factory=list)
    broken: bool = False

    def add(self, x: float | None) -> float | None:
        """The average after x. A null within the seed makes it a plain mean of the last window values for good."""
        self.seed = [*self.seed, x][-self.window :]
        i, self.n = self.n, self.n + 1
        whole = len(self.seed) == self.window and None not in self.seed
        mean = sum(self.seed) / self.window if whole else None
        if i == self.window:
            self.broken, self.value = not whole, mean
        elif i > self.window and not self.broken and x is not None:
            self.value = (self.value * (self.window - 1) + x) / self.window
        return (mean if self.broken else self.value) if i >= self.window else None


@dataclass
class Zone:
    type: str
    top: float
    bottom: float
    created_i: int
    source_i: int
    met: bool = False
    inverted: bool = False

    def meets(self, low: float, high: float) -> bool:
        return low <= self.top and high >= self.bottom


@dataclass
class Desk:
    """What a symbol's bars have come to. zones: by trigger."""

    atr: Wilder
    gain: Wilder
    loss: Wilder
    i: int = -1
    bars: list[Bar] = field(default_factory=list)
    swing_high: float | None = None
    swing_low: float | None = None
    side: int = 0
    zones: dict[str, list[Zone]] = field(default_factory=lambda: {"fvg": [], "ifvg": [], "order_block": []})


def desk(cfg: Config) -> Desk:
    f = cfg.features
    return Desk(Wilder(f.atr_window), Wilder(f.rsi_window), Wilder(f.rsi_window))


def dumped(d: Desk) -> str:
    return json.dumps(asdict(d))


def loaded(text: str) -> Desk:
    d = json.loads(text)
    wilder = {c: Wilder(**d[c]) for c in ("atr", "gain", "loss")}
    return Desk(**(d | wilder | {"zones": {k: [Zone(**z) for z in zs] for k, zs in d["zones"].items()}}))


def _averages(d: Desk, bar: Bar) -> dict:
    """atr and rsi at the bar."""
    high, low, close = (known(bar[c]) for c in ("high", "low", "close"))
    before = d.bars[-1]["close"] if d.bars else None
    own = high - low if high is not None and low is not None else None
    true = own if own is None or before is None else max(own, abs(high - before), abs(low - before))
    change = close - before if close is not None and before is not None else 0.0
    atr, gain, loss = d.atr.add(true), d.gain.add(max(change, 0.0)), d.loss.add(max(-change, 0.0))
    rsi = None if gain is None else 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
    return {"atr": atr, "rsi": rsi}


def _swings(bars: list[Bar], lookback: int) -> tuple[float | None, float | None]:
    """The high and the low that the last bar confirms: those of the bar lookback bars before, if no neighbour within lookback reaches them."""
    last = bars[-2 * lookback - 1 :]
    if lookback <= 0 or len(last) <= 2 * lookback or any(b[c] is None for b in last for c in ("high", "low")):
        return None, None
    mid, others = last[lookback], last[:lookback] + last[lookback + 1 :]
    high = mid["high"] if all(b["high"] < mid["high"] for b in others) else None
    return high, mid["low"] if all(b["low"] > mid["low"] for b in others) else None


def _structure(d: Desk, lookback: int, close: float | None) -> int:
    """The break of structure (1, -1, 0) at the last bar; swings and the side are kept up."""
    high, low = _swings(d.bars, lookback)
    bos = 0
    if high is not None and d.swing_high is not None and close is not None and close > d.swing_high:
        bos, d.side = (1 if d.side > 0 else 0), 1
    if low is not None and d.swing_low is not None and close is not None and close < d.swing_low:
        bos, d.side = (-1 if d.side < 0 else bos), -1
    d.swing_high = high if high is not None else d.swing_high
    d.swing_low = low if low is not None else d.swing_low
    return bos


def _signal(d: Desk, bar: Bar, atr: float | None, cfg: Config) -> dict:
    ict = cfg.features.ict
    none = {"direction": "none", "entry_type": "none", "stop_dist": None, "target_dist": None}
    if not atr or atr <= 0 or bar["high"] is None or bar["low"] is None:
        return none
    tol = atr * ict.ifvg_retest_atr_tol
    for trigger in trigger_order(ict.primary_entry, ict.ifvg_enabled):
        fits = [z for z in d.zones[trigger] if not z.met and z.meets(bar["low"] - tol, bar["high"] + tol) and (d.side >= 0 if z.type == "bullish" else d.side <= 0)]
        if fits:
            first = min(fits, key=lambda z: z.source_i)
            return {"direction": "long" if first.type == "bullish" else "short", "entry_type": trigger, "stop_dist": atr * cfg.labeling.stop_atr_mult, "target_dist": atr * cfg.labeling.target_atr_mult}
    return none


def _zones(d: Desk, bar: Bar, atr: float | None, bos: int, cfg: Config) -> None:
    """Zones after a bar: met ones, inverted ones, and what the bar makes."""
    high, low, close, ict = bar["high"], bar["low"], bar["close"], cfg.features.ict
    for z in d.zones["fvg"] + d.zones["ifvg"]:
        z.met = z.met or (high is not None and low is not None and z.meets(low, high))
    turned = []
    for z in d.zones["fvg"]:
        if not z.inverted and close is not None and (close < z.bottom if z.type == "bullish" else close > z.top):
            z.inverted = True
            turned.append(Zone("bearish" if z.type == "bullish" else "bullish", z.top, z.bottom, d.i, z.source_i))
    d.zones["fvg"] = [z for z in d.zones["fvg"] if not (z.met and z.inverted)]
    d.zones["ifvg"] = [z for z in d.zones["ifvg"] if not z.met] + turned
    old = d.bars[-3] if len(d.bars) > 2 else {"high": None, "low": None}
    if None not in (high, low, old["high"], old["low"]):
        made = Zone("bullish", low, old["high"], d.i, d.i) if old["high"] < low else Zone("bearish", old["low"], high, d.i, d.i) if old["low"] > high else None
        if made and made.top - made.bottom >= (atr * ict.fvg_min_gap_atr if atr is not None else 0.0):
            d.zones["fvg"].append(made)
    if bos:
        against = [b for b in d.bars[-ict.order_block_lookback - 1 : -1] if b["close"] is not None and b["open"] is not None and (b["close"] - b["open"]) * bos < 0]
        if against and against[-1]["high"] is not None and against[-1]["low"] is not None:
            d.zones["order_block"].append(Zone("bullish" if bos > 0 else "bearish", against[-1]["high"], against[-1]["low"], d.i, d.i))


def advance(d: Desk, bar: Bar, cfg: Config, chance: Callable[[Bar], float | None]) -> Bar:
    """The bar with i, atr, rsi, ms_bias, its signal and its probability; d is brought up to it. bar: open, high, low, close."""
    ict = cfg.features.ict
    bar = {k: known(v) if k in ("open", "high", "low", "close") else v for k, v in bar.items()}
    told = _averages(d, bar)
    d.i += 1
    d.bars = [*d.bars, {k: bar[k] for k in ("open", "high", "low", "close")}][-max(2 * ict.swing_lookback, ict.order_block_lookback, 2) - 1 :]
    bos = _structure(d, ict.swing_lookback, bar["close"])
    out = bar | told | {"i": d.i, "ms_bias": d.side} | _signal(d, bar, told["atr"], cfg)
    _zones(d, bar, told["atr"], bos, cfg)
    return out | {"probability": chance(out)}


def by_rsi(bar: Bar) -> float | None:
    """A stand-in for a model: the RSI as a share."""
    return None if bar["rsi"] is None else bar["rsi"] / 100


class DeskProcessor(StatefulProcessor):
    """One symbol's desk and account. quiet_s: event time after its last bar at which an open position is closed, at the last close."""

    def __init__(self, cfg: Config, chance: Callable[[Bar], float | None], quiet_s: int | None) -> None:
        self.cfg, self.chance, self.quiet_s = cfg, chance, quiet_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("desk", "desk string, book string, close double, timer long")

    def _read(self) -> tuple[Desk, Book, float | None, int | None]:
        if not self.state.exists():
            return desk(self.cfg), opened(self.cfg), None, None
        text, book, close, timer = tuple(self.state.get())
        own = json.loads(book)
        return loaded(text), Book(*own[:4], None if own[4] is None else Position(*own[4])), close, timer

    def _write(self, d: Desk, book: Book, close: float | None, timer: int | None) -> None:
        self.state.update((dumped(d), json.dumps([*book[:4], None if book.open is None else list(book.open)]), close, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        d, book, close, timer = self._read()
        fills, last = [], None
        for bar in pd.concat(list(rows)).sort_values("timestamp").to_dict("records"):
            full = advance(d, bar, self.cfg, self.chance)
            book, fill = step(book, full, self.cfg)
            close, last = (full["close"] if full["close"] is not None else close), bar["timestamp"]
            fills += [{"symbol": key[0], **fill}] if fill else []
        if self.quiet_s is not None and last is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(pd.Timestamp(last).tz_localize("UTC").timestamp() if pd.Timestamp(last).tzinfo is None else pd.Timestamp(last).timestamp()) * 1000 + self.quiet_s * 1000
            self.handle.registerTimer(timer)
        self._write(d, book, close, timer)
        if fills:
            yield pd.DataFrame(fills)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        d, book, close, timer = self._read()
        if timer is not None and expiredTimerInfo.getExpiryTimeInMs() == timer:
            fill = None
            if book.open:
                book, fill = settled(book, d.i, close, "forced", self.cfg)
            self._write(d, book, close, None)
            if fill:
                yield pd.DataFrame([{"symbol": key[0], **fill}])

    def close(self) -> None:
        pass


def desk_fills(bars: DataFrame, cfg: Config, chance: Callable[[Bar], float | None] = by_rsi, quiet_s: int | None = None) -> DataFrame:
    """Fills of a stream of bars (stream_bars(): symbol, timestamp with a watermark, prices). A symbol's bars come in order, as its intervals close in order.
    chance: a bar with its signal, atr, rsi and ms_bias -> probability. Needs the RocksDB state store."""
    own = bars.select("symbol", "timestamp", "open", "high", "low", "close")
    return own.groupBy("symbol").transformWithStateInPandas(statefulProcessor=DeskProcessor(cfg, chance, quiet_s), outputStructType=FILL, outputMode="Append", timeMode="EventTime" if quiet_s is not None else "None")
