"""Data sources: made-up walks and the terminal, with a stand-in for its package."""

import itertools
import random
import sys
import textwrap
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.sources import broker
from tickloom.sources.walk import LEAST, MOST, WalkReader, bounds, walk, walk_bars


def test_walks(spark):
    df = walk_bars(spark, rows=200, symbols=3)
    rows = df.orderBy("symbol", "i").collect()
    assert [r.symbol for r in rows[::200]] == ["SAMPLE", "SAMPLE_1", "SAMPLE_2"] and df.rdd.getNumPartitions() == 3
    first = rows[:200]
    # fixed values: the first two bars of the default walk
    assert [tuple(r)[3:] for r in first[:2]] == [(2000.0, 2002.98, 1997.0, 2002.58, 1921.15), (2002.58, 2005.9, 2002.4, 2004.75, 855.79)]
    assert [tuple(r)[3:] for r in first] == list(itertools.islice(walk(7, 2000.0), 200))
    assert [tuple(r)[3:] for r in rows[200:400]] == list(itertools.islice(walk(8, 2000.0), 200))
    assert all(b.open == a.close for a, b in zip(first, first[1:])) and all(LEAST * 0.99 < r.close < MOST * 1.01 for r in rows)
    assert {(b.timestamp - a.timestamp).seconds for a, b in zip(first, first[1:])} == {900}
    assert walk_bars(spark, rows=0).count() == 0


def test_bounds_of_time_reach_the_reader(spark):
    df = walk_bars(spark, rows=100, timeframe="H1").filter((F.col("timestamp") >= "2023-01-03 00:00:00") & (F.col("timestamp") < "2023-01-03 05:00:00") & (F.col("close") > 0))
    assert sorted(r.i for r in df.collect()) == [24, 25, 26, 27, 28]
    from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan

    reader = WalkReader({"rows": "100", "timeframe": "H1"})
    list(reader.pushFilters([GreaterThanOrEqual(("timestamp",), datetime(2023, 1, 3, tzinfo=timezone.utc)), LessThan(("timestamp",), datetime(2023, 1, 3, 5, tzinfo=timezone.utc))]))
    assert [r[1] for r in reader.read(reader.partitions()[0])] == [24, 25, 26, 27, 28, 29]  # a bound may let its own bar through; Spark filters again
    a, b = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert bounds([GreaterThan(("timestamp",), a), LessThan(("timestamp",), b), LessThan(("close",), 5.0)]) == (a, b)


def test_walks_as_a_stream(spark):
    from tickloom.sources.walk import SampleWalk, register

    register(spark, SampleWalk)
    stream = spark.readStream.format("sample_walk").options(rows=50, symbols=2).load()
    q = stream.writeStream.format("memory").queryName("walks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("walks").collect())) == sorted(map(tuple, walk_bars(spark, rows=50, symbols=2).collect()))


TERMINAL = """
import numpy as np
TIMEFRAME_H1 = 16385
KIND = [("time", "i8"), ("open", "f8"), ("high", "f8"), ("low", "f8"), ("close", "f8"), ("tick_volume", "i8")]
RATES = np.array([(1704067200 + 3600 * k, 10 + k, 11 + k, 9 + k, 10.5 + k, k) for k in range(48)][::-1], KIND)
MODE, calls = "MODE_HERE", []
def initialize(**account): return account.get("password") != "wrong"
def shutdown(): calls.append("shutdown")
def last_error(): return (-1, "refused")
def symbol_info(symbol): return None if symbol == "NONE" else object()
def symbol_select(symbol, on): calls.append(symbol)
def copy_rates_range(symbol, frame, start, end): return RATES if MODE == "range" else None
def copy_rates_from(symbol, frame, end, count): return RATES if MODE == "count" else []
def copy_rates_from_pos(symbol, frame, first, count): return RATES
"""


@pytest.mark.parametrize("mode", ["range", "count", "place"])
def test_the_terminal_is_asked_until_it_answers(tmp_path, monkeypatch, mode):
    (tmp_path / f"terminal_{mode}.py").write_text(textwrap.dedent(TERMINAL.replace("MODE_HERE", mode)))
    monkeypatch.syspath_prepend(str(tmp_path))
    reader = broker.TerminalReader({"module": f"terminal_{mode}", "symbols": "A, B", "timeframe": "h1", "start": "2024-01-01T05:00:00", "end": "2024-01-01T08:00:00"})
    parts = reader.partitions()
    assert [p.value for p in parts] == ["A", "B"]
    rows = list(reader.read(parts[1]))
    assert [(r[0], r[1], r[2].hour, r[3], r[7]) for r in rows] == [("B", k, 5 + k, 15.0 + k, 5.0 + k) for k in range(4)]
    terminal = sys.modules[f"terminal_{mode}"]
    assert terminal.calls[-1] == "shutdown"
    with pytest.raises(broker.BrokerUnavailable, match="no symbol"):
        broker.terminal_rows(terminal, "NONE", "H1", datetime(2024, 1, 1), datetime(2024, 1, 2))
    with pytest.raises(broker.BrokerUnavailable, match="does not start"):
        broker.terminal_rows(terminal, "A", "H1", datetime(2024, 1, 1), datetime(2024, 1, 2), password="wrong")
    with pytest.raises(broker.BrokerUnavailable, match="none from"):
        broker.terminal_rows(terminal, "A", "H1", datetime(2025, 1, 1), datetime(2025, 1, 2))
    with pytest.raises(ValueError, match="timeframe"):
        broker.terminal_rows(terminal, "A", "M1", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert broker.has_field(terminal.RATES[0], "tick_volume") and not broker.has_field((1, 2), "time")
    assert broker._fields((5, 1, 2, 0, 1)) == (5, 1.0, 2.0, 0.0, 1.0, 0.0)


def test_filters_narrow_what_the_terminal_is_asked_for():
    from pyspark.sql.datasource import GreaterThanOrEqual

    reader = broker.TerminalReader({"start": "2024-01-01T00:00:00"})
    list(reader.pushFilters([GreaterThanOrEqual(("timestamp",), datetime(2024, 3, 1, tzinfo=timezone.utc))]))
    assert reader.options["start"] == datetime(2024, 3, 1)


def test_without_the_package_reading_says_so(spark):
    assert random.Random(7).random()  # the walk's generator is the library's
    with pytest.raises(Exception, match="not available here"):
        broker.fetch_bars(spark, "A", start="2024-01-01", end="2024-01-02").collect()
