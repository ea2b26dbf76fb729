"""Made-up bars as a data source, batch and stream: spark.read.format("sample_walk").options(rows=300, seed=7, symbols=3).load().

Each symbol is one walk, drawn in order from its seed, and one partition. Options: rows, seed, start_price, start_time, timeframe, symbol, symbols (the first is called symbol, the others
symbol_1 and so on, each with the next seed). Filters on timestamp are pushed down: what lies outside is walked through but not sent. A stream has all rows at
once, and begins after what its checkpoint knows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .bars import minutes

BARS = "symbol string, i long, timestamp timestamp, open double, high double, low double, close double, volume double"
#: Fixed values of the process: volatility of a bar in quiet times; the shares by which variance persists and takes up a shock; the band of prices, the level that they are drawn to, and how strongly; volume.
QUIET, PERSISTS, TAKES_UP = 0.0025, 0.94, 0.06
LEAST, MOST, LEVEL, PULL = 1800.0, 2400.0, 2100.0, 0.001
VOLUME, BUSY = 500.0, 4000.0


def walk(seed: int, price: float) -> Iterator[tuple[float, float, float, float, float]]:
    """open, high, low, close, volume without end. A close outside the band is set back inside it after the range is drawn, so it may lie outside its bar's range."""
    rng, sigma = random.Random(seed), QUIET
    while True:
        shock, noise = rng.gauss(0.0, 1.0), rng.gauss(0.0, 1.0)
        width, above, below, trade = (rng.random() for _ in range(4))
        sigma = math.sqrt(PERSISTS * sigma**2 + TAKES_UP * QUIET**2 * shock**2 + (1.0 - PERSISTS - TAKES_UP) * QUIET**2)
        move = PULL * (LEVEL - price) / LEVEL + sigma * noise
        end, reach = price * (1.0 + move), abs(price) * sigma * (0.5 + width)
        top, bottom = max(price, end) + reach * above, max(min(price, end) - reach * below, 1.0)
        inside = LEAST + abs(move) * end if end < LEAST else MOST - abs(move) * end if end > MOST else end
        yield *(round(v, 2) for v in (price, top, bottom, inside)), round(VOLUME + BUSY * (sigma / QUIET) * trade, 2)
        price = inside


class Symbols(InputPartition):
    def __init__(self, number: int, first: int = 0, after: int | None = None) -> None:
        super().__init__(number)
        self.number, self.first, self.after = number, first, after


class Walks:
    """What batch and stream share: the options, and a partition's rows."""

    def __init__(self, options: dict) -> None:
        told = lambda name, default: type(default)(options.get(name, default))
        self.rows, self.seed, self.symbols = told("rows", 300), told("seed", 7), told("symbols", 1)
        self.price, self.symbol = told("start_price", 2000.0), told("symbol", "SAMPLE")
        self.start = datetime.fromisoformat(told("start_time", "2023-01-02T00:00:00")).replace(tzinfo=timezone.utc)
        self.step = timedelta(minutes=minutes(told("timeframe", "M15")))
        self.since = self.until = None

    def rows_of(self, part: Symbols) -> Iterator[tuple]:
        name = self.symbol if part.number == 0 else f"{self.symbol}_{part.number}"
        for i, bar in zip(range(self.rows if part.after is None else part.after), walk(self.seed + part.number, self.price)):
            at = self.start + i * self.step
            if i >= part.first and (self.since is None or at >= self.since) and (self.until is None or at <= self.until):
                yield name, i, at, *bar
            if self.until is not None and at > self.until:
                return


class WalkReader(Walks, DataSourceReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of timestamp narrow what is sent; all filters are left to Spark as well, so bounds may be taken as closed."""
        self.since, self.until = bounds(filters)
        yield from filters

    def partitions(self) -> list[Symbols]:
        return [Symbols(k) for k in range(self.symbols)]

    def read(self, partition: Symbols) -> Iterator[tuple]:
        return self.rows_of(partition)


def bounds(filters: list) -> tuple[datetime | None, datetime | None]:
    """The times between which timestamp must lie, by these filters."""
    since = until = None
    for f in filters:
        if getattr(f, "attribute", None) != ("timestamp",) or not isinstance(getattr(f, "value", None), datetime):
            continue
        at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            since = at if since is None else max(since, at)
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            until = at if until is None else min(until, at)
    return since, until


class WalkStream(Walks, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"i": 0}

    def latestOffset(self) -> dict:
        return {"i": self.rows}

    def partitions(self, start: dict, end: dict) -> list[Symbols]:
        return [Symbols(k, start["i"], end["i"]) for k in range(self.symbols)]

    def read(self, partition: Symbols) -> Iterator[tuple]:
        return self.rows_of(partition)


class SampleWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_walk"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: object) -> WalkReader:
        return WalkReader(self.options)

    def streamReader(self, schema: object) -> WalkStream:
        return WalkStream(self.options)


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a source known to the session. Sources that take filters need the setting that lets Spark hand them over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def walk_bars(spark: SparkSession, **options: object) -> DataFrame:
    """Bars of the source, which is registered with the session."""
    register(spark, SampleWalk)
    return spark.read.format("sample_walk").options(**options).load()
