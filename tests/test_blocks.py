"""Windows, scans and trades over blocks of bars: narrow blocks give what one block gives, and no window is over a symbol's bars."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_bars import frame, noise

from tickloom.config import Config, from_dict
from tickloom.functions import series
from tickloom.functions.candles import patterns
from tickloom.operators import backtest as bt
from tickloom.operators import indicators as ind
from tickloom.operators import metrics as mt
from tickloom.operators import scan
from tickloom.operators import structure as sr


def bars(spark):
    raw = [b if k not in (3, 14, 47, 48) else (b[0], None, None, None if k == 47 else b[3]) for k, b in enumerate(noise(150, 4))]
    return frame(spark, raw).unionByName(frame(spark, noise(61, 9)).withColumn("symbol", F.lit("other")))


def windowed(df):
    """All that stands on windows."""
    df = ind.channel(ind.bollinger(ind.volatility(ind.returns(df, (1, 5, 10)))))
    df = sr.premium_discount(sr.liquidity(sr.swing_points(ind.sma(ind.true_range(df), 7), 4).withColumn("atr", F.lit(2.0)), 30), 25)
    return series.over(df, 1, lambda d: d.withColumns(patterns()))


def scanned(df):
    df = ind.oscillators(sr.market_structure(ind.atr(df, 14), 3), (9, 50), 14, 12, 26, 9)
    return scan.carried(df, {"top": ("max", F.col("high"), 0), "sum": ("sum", F.col("volume"), -1), "known": ("last", F.col("low"), -1)})


@pytest.mark.parametrize("width", [16, 40])
def test_narrow_blocks_give_the_same(spark, monkeypatch, width):
    wide = [f(bars(spark)).orderBy("symbol", "i").collect() for f in (windowed, scanned)]
    monkeypatch.setattr(series, "WIDTH", width)
    monkeypatch.setattr(scan, "BLOCK", width)
    narrow = [f(bars(spark)).orderBy("symbol", "i").collect() for f in (windowed, scanned)]
    assert narrow[0] == wide[0]  # to the last bit
    for a, b in zip(*(n[1] for n in (narrow, wide))):
        for name, x, y in zip(a.__fields__, a, b):
            assert (x is None) == (y is None) and (x == y or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y))), (a.symbol, a.i, name, x, y)


def test_no_window_is_over_a_symbol(spark):
    """In the plans of windows; scans order one row a block by symbol, and nothing else."""
    plan = windowed(bars(spark))._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert found and all(series.HALO in f for f in found)


def test_one_symbol_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(series, "WIDTH", 64)
    one = spark.range(6400).select(F.lit("A").alias("symbol"), F.col("id").alias("i"), (F.col("id") % 17).cast("double").alias("close"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = ind.sma(one, 20).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 4 and max(r["count"] for r in rows) < 0.5 * 6400


def test_narrow_blocks_take_the_same_trades(spark, monkeypatch):
    rng = random.Random(12)
    cfg = from_dict({"risk": {"max_drawdown_pct": 0.3, "max_position_lots": 0.4}})
    more = spark.createDataFrame([(i, rng.choice(["long", "short", "none"]), rng.choice([0.5, 2.0]), 3.0, rng.random(), "fvg", i > 10) for i in range(150)], "i long, direction string, stop_dist double, target_dist double, probability double, entry_type string, tradable boolean")
    df = bars(spark).filter("symbol != 'other'").join(more, "i")

    def run():
        trades, curve, summary = bt.backtest(df, cfg)
        return [[tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in t.orderBy(*t.columns[:2]).collect()] for t in (trades, curve, summary, mt.drawdowns(mt.bar_returns(curve)))]

    wide = run()
    monkeypatch.setattr(series, "WIDTH", 8)
    assert run() == wide and len(wide[0]) > 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 5), st.floats(-8, 8)), min_size=1, max_size=12), st.floats(-100, 50_000), st.floats(0.01, 0.5), st.floats(0.05, 5))
def test_maps_of_equity_are_its_trades(trades, equity, risk, most):
    """The map of a block of trades against the trades one by one."""
    cfg = from_dict({"risk": {"risk_per_trade": risk, "max_position_lots": most}})
    pieces, e = [(0.0, 1.0, 0.0)], equity
    for stop, move in trades:
        pieces = bt.mapped(pieces, stop, move, cfg)
        e += bt._opened(e, stop, move, cfg)[2]
    if equity > 0:
        k = int(np.searchsorted([p[0] for p in pieces], equity, "right")) - 1
        assert abs(pieces[k][1] * equity + pieces[k][2] - e) <= 1e-6 * max(1, abs(e), abs(equity))
    else:
        assert e == equity


def test_no_lots_no_trades(spark):
    cfg = from_dict({"risk": {"risk_per_trade": 0.0}})
    more = spark.createDataFrame([(i, "long", 1.0, 1.0, 1.0, "fvg", True) for i in range(40)], "i long, direction string, stop_dist double, target_dist double, probability double, entry_type string, tradable boolean")
    trades, curve, summary = bt.backtest(frame(spark, noise(40, 1)).join(more, "i"), cfg)
    assert trades.count() == 0 and {r.equity for r in curve.collect()} == {Config().backtest.initial_capital} and summary.count() == 1
