"""The broker terminal as a source. The terminal's package runs on one platform only; without it, reading raises."""

from __future__ import annotations

import calendar
import importlib
import importlib.util
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bars import TIMEFRAMES
from .walk import BARS, bounds, register

#: Fixed value: the package's name.
MODULE = "MetaTrader5"

#: Bars of a day, as the terminal counts the timeframes, for one it does not know, and the most that may be asked for at once.
UNKNOWN_BARS, MOST_BARS, SPARE = 288, 400_000, 1.2


class BrokerUnavailable(RuntimeError):
    pass


def available() -> bool:
    return importlib.util.find_spec(MODULE) is not None


def bar_count(timeframe: str, start: datetime, end: datetime) -> int:
    """Bars to ask for where a range gives nothing: a fifth more than the days hold, and 10; 10 at least, MOST_BARS at most."""
    minutes = TIMEFRAMES.get(str(timeframe).upper())
    per_day = 1440 // minutes if minutes else UNKNOWN_BARS
    days = max(1.0, (end - start).total_seconds() / 86400.0)
    return max(10, min(int(days * per_day * SPARE) + 10, MOST_BARS))


def fetch_window(start: str | None, end: str | None, days: int | None) -> tuple[str | None, str | None]:
    """Given bounds stand; days fills those that lack, back from the end or from now (UTC)."""
    if days is None:
        return start, end
    anchor = datetime.fromisoformat(end) if end else datetime.now(timezone.utc).replace(tzinfo=None)
    return start or (anchor - timedelta(days=int(days))).isoformat(), end or anchor.isoformat()


def timeframe_of(terminal: ModuleType, timeframe: str) -> object:
    """The terminal's own constant for a timeframe."""
    name = f"TIMEFRAME_{str(timeframe).upper()}"
    if str(timeframe).upper() not in TIMEFRAMES or not hasattr(terminal, name):
        raise ValueError(f"the terminal has no timeframe {timeframe!r}")
    return getattr(terminal, name)


def has_field(record: object, name: str) -> bool:
    """Whether a record of the terminal has a named field."""
    return name in (getattr(getattr(record, "dtype", None), "names", None) or ())


def _time(value: object) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def _fields(record: object) -> tuple[int, float, float, float, float, float]:
    """Seconds, prices and volume (ticks; 0 without them) of a record, by name, or by place if it has no names."""
    names = ("time", "open", "high", "low", "close")
    at, *prices = (record[n] if has_field(record, n) else record[k] for k, n in enumerate(names))
    return int(at), *map(float, prices), float(record["tick_volume"]) if has_field(record, "tick_volume") else 0.0


def terminal_rows(terminal: ModuleType, symbol: str, timeframe: str, start: datetime, end: datetime, **account: object) -> list[tuple]:
    """(seconds, open, high, low, close, volume) from start to end, in order. If the terminal has no such range at hand, a count of bars back from the end is asked for, then one
    back from the newest bar, and cut to the range. The terminal's clock is left as it is."""
    if not terminal.initialize(**account):
        raise BrokerUnavailable(f"the terminal does not start: {_last_error(terminal)}")
    try:
        frame = timeframe_of(terminal, timeframe)
        if hasattr(terminal, "symbol_info") and terminal.symbol_info(symbol) is None:
            raise BrokerUnavailable(f"the account has no symbol {symbol!r}; names must be spelt as the terminal does: {_last_error(terminal)}")
        if hasattr(terminal, "symbol_select"):
            terminal.symbol_select(symbol, True)
        count = bar_count(timeframe, start, end)
        asks = (("copy_rates_range", (start, end)), ("copy_rates_from", (end, count)), ("copy_rates_from_pos", (0, count)))
        found: Sequence = ()
        for name, args in asks:
            if len(found) == 0 and hasattr(terminal, name):
                got = getattr(terminal, name)(symbol, frame, *args)
                found = () if got is None else got
    finally:
        terminal.shutdown()
    if len(found) == 0:
        raise BrokerUnavailable(f"the terminal has no bars of {symbol!r}, {timeframe}: {_last_error(terminal)}")
    lo, hi = (calendar.timegm(t.timetuple()) for t in (start, end))
    rows = sorted(r for r in map(_fields, found) if lo <= r[0] <= hi)
    if not rows:
        raise BrokerUnavailable(f"the terminal has bars of {symbol!r}, but none from {start} to {end}")
    return rows


def _last_error(terminal: ModuleType) -> object:
    return terminal.last_error() if hasattr(terminal, "last_error") else "no reason given"


class TerminalReader(DataSourceReader):
    """A partition a symbol. Bounds of timestamp in a filter narrow the range that is asked for."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def pushFilters(self, filters: list) -> Iterator:
        since, until = bounds(filters)
        plain = lambda t: t.astimezone(timezone.utc).replace(tzinfo=None)
        if since is not None:
            self.options["start"] = max(plain(since), _time(self.options["start"])) if self.options.get("start") else plain(since)
        if until is not None:
            self.options["end"] = min(plain(until), _time(self.options["end"])) if self.options.get("end") else plain(until)
        yield from filters

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s.strip()) for s in self.options.get("symbols", self.options.get("symbol", "SAMPLE")).split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        name = o.get("module", MODULE)
        if importlib.util.find_spec(name) is None:
            raise BrokerUnavailable("the broker terminal's package is not available here: export bars to CSV where it runs, and load them with sources.csv.read_bars()")
        start = _time(o["start"]) if o.get("start") else datetime(1970, 1, 1)
        end = _time(o["end"]) if o.get("end") else datetime.now(timezone.utc).replace(tzinfo=None)
        account = {k: int(o[k]) if k == "login" else o[k] for k in ("login", "password", "server") if o.get(k)}
        for i, (at, *bar) in enumerate(terminal_rows(importlib.import_module(name), partition.value, o.get("timeframe", "M15"), start, end, **account)):
            yield partition.value, i, datetime.fromtimestamp(at, timezone.utc), *bar


class TerminalBars(DataSource):
    """spark.read.format("terminal_bars").options(symbols="A,B", timeframe="M5", start=..., end=..., login=..., password=..., server=...).load(), where the terminal runs on the executors."""

    @classmethod
    def name(cls) -> str:
        return "terminal_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: object) -> TerminalReader:
        return TerminalReader(self.options)


def fetch_bars(spark: SparkSession, symbol: str, timeframe: str = "M15", start: str | None = None, end: str | None = None, **options: str) -> DataFrame:
    """Bars of the terminal's symbols (names with commas between), lazily: without the terminal's package, reading raises BrokerUnavailable."""
    register(spark, TerminalBars)
    given = {"symbols": symbol, "timeframe": timeframe, "start": start, "end": end, **options}
    return spark.read.format("terminal_bars").options(**{k: v for k, v in given.items() if v is not None}).load()
