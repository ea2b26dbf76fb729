import dataclasses
import math
import random
from datetime import datetime, timedelta

import loops
import pytest
from pyspark.sql import functions as F

from tickloom.config import Config, from_dict, load_config
from tickloom.functions.candles import patterns, sessions
from tickloom.functions.series import over
from tickloom.operators import backtest as bt
from tickloom.operators import features as ft
from tickloom.operators import folds as fd
from tickloom.operators import indicators as ind
from tickloom.operators import model as md
from tickloom.operators import scan
from tickloom.operators import structure as st
from tickloom.operators import zones as z
from tickloom.operators.labels import triple_barrier
from tickloom.operators.metrics import metrics, report
from tickloom.operators.risk import net_pnl, position_size
from tickloom.operators.scan import ewm
from tickloom.plans.guard import OrdersDisabled, live_allowed, route_order
from tickloom.sources.broker import BrokerUnavailable, bar_count, fetch_bars, fetch_window
from tickloom.sources.csv import BadBars, read_bars, write_bars
from tickloom.sources.sample import sample_bars

SCHEMA = "symbol string, i long, timestamp timestamp, open double, high double, low double, close double, volume double"
T0 = datetime(2024, 1, 1)


def frame(spark, bars, symbol="A"):
    return spark.createDataFrame([(symbol, i, T0 + timedelta(hours=i), *b, 1.0) for i, b in enumerate(bars)], SCHEMA)


def column(df, name, symbol="A"):
    return [r[0] for r in df.filter(F.col("symbol") == symbol).orderBy("i").select(name).collect()]


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))


def noise(n, seed, gaps=0.0):
    rng, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, c = p, max(1.0, p + rng.gauss(0, 2))
        bar = (o, max(o, c) + rng.random(), min(o, c) - rng.random(), c)
        out.append((None,) * 4 if rng.random() < gaps else bar)
        p = c
    return out


#: The hand-made candles of the tests below show each rule at its edge.


def of_closes(xs):
    return [(x, None if x is None else x + 1, None if x is None else x - 1, x) for x in xs]


def test_returns_and_mean(spark):
    df = ind.sma(ind.returns(frame(spark, of_closes([100.0, 110.0, 99.0, 0.0, 5.0])), (1,)), 3)
    assert close(column(df, "ret_1"), [None, 0.1, -0.1, -1.0, None])
    assert column(df, "logret_1")[3:] == [None, None]
    assert close(column(df, "sma_3"), [None, None, 103.0, 209 / 3, 104 / 3])


@pytest.mark.parametrize("gaps", [0.0, 0.1])
def test_recurrences_match_loops(spark, gaps):
    bars = noise(400, 3, gaps)
    df = ind.atr(ind.ema(frame(spark, bars), (9,)))
    assert close(column(df, "ema_9"), loops.ema([b[3] for b in bars], 0.2))
    assert close(column(df, "atr"), loops.atr(bars))


def test_long_recurrence_crosses_blocks(spark):
    bars = noise(2500, 4)
    df = ewm(frame(spark, bars), "y", F.col("close"), alpha=0.3)
    assert close(column(df, "y"), loops.ema([b[3] for b in bars], 0.3))
    one = ewm(frame(spark, of_closes([1.0, None, 3.0])), "y", F.col("close"), alpha=1.0)
    assert column(one, "y") == [1.0, 1.0, 3.0]
    adjusted = ewm(frame(spark, of_closes([None, 1.0, None, 3.0])), "y", F.col("close"), alpha=0.5, adjust=True)
    assert close(column(adjusted, "y"), [None, 1.0, 1.0, (3 + 0.5) / 1.5])


def test_blocks_with_gaps_and_a_hot_symbol(spark, monkeypatch):
    """Short blocks, many of them without a value; a symbol's bars lie in several partitions when the recurrence runs."""
    monkeypatch.setattr(scan, "BLOCK", 16)
    for gaps in (0.0, 0.5, 0.97):
        xs = [b[3] for b in noise(700, 9, gaps)]
        df = frame(spark, of_closes(xs))
        for alpha in (0.01, 0.3):
            assert close(column(ewm(df, "y", F.col("close"), alpha=alpha), "y"), loops.ema(xs, alpha))
    plan = ewm(frame(spark, of_closes([1.0] * 700)), "y", F.col("close"), alpha=0.1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_block" in plan.split("hashpartitioning(symbol")[1][:40]


def test_distance_by_brute_force(spark):
    rng, bars = random.Random(3), noise(300, 12)
    zones = [(rng.randint(0, 299), *sorted((rng.uniform(70, 130), rng.uniform(70, 130)))) for _ in range(40)] + [(10, 100.0, 100.0)]
    zf = spark.createDataFrame([("A", hi, lo, c) for c, lo, hi in zones], "symbol string, top double, bottom double, created_i long")
    want = [min((max(0.0, b[3] - hi, lo - b[3]) / 2 for c, lo, hi in zones if c <= i), default=None) for i, b in enumerate(bars)]
    assert close(column(z.distance_to_nearest(frame(spark, bars).withColumn("atr", F.lit(2.0)), zf, "d"), "d"), want)


def test_short_series_and_constant_closes(spark):
    df = ind.macd(ind.rsi(ind.atr(frame(spark, of_closes([5.0] * 10)))))
    assert set(column(df, "rsi")) == set(column(df, "atr")) == set(column(df, "macd")) == {None}
    assert column(ind.rsi(frame(spark, of_closes([5.0] * 16))), "rsi")[14:] == [100.0, 100.0]


def test_patterns(spark):
    one = lambda *bars: over(frame(spark, bars), 1, lambda b: b.withColumns(patterns()))
    assert column(one((100.0, 105.0, 95.0, 100.2), (100.0, 105.0, 99.0, 104.5)), "is_doji") == [True, False]
    assert column(one((100.0, 100.3, 95.0, 100.3), (5.0, 5.0, 5.0, 5.0)), "is_hammer") == [True, False]
    assert column(one((100.3, 105.0, 100.0, 100.0)), "is_shooting_star") == [True]
    assert column(one((100.0, 101.0, 98.0, 98.5), (98.0, 102.0, 97.5, 101.5), (101.5, 102.0, 97.0, 98.0)), "is_bullish_engulfing") == [None, True, False]
    assert column(one((98.0, 102.0, 97.5, 101.5), (101.5, 102.0, 97.0, 98.0), (None, 1.0, 1.0, 1.0)), "is_bearish_engulfing") == [None, True, None]


def test_sessions(spark):
    df = frame(spark, of_closes([1.0] * 24)).withColumns(sessions(("london", "nowhere")))
    assert [i for i, x in enumerate(column(df, "in_killzone")) if x] == [7, 8, 9]
    assert not any(column(df, "in_nowhere"))


def test_swings_need_a_unique_top_and_come_late(spark):
    highs = [1, 2, 3, 9, 3, 2, 1, 5, 5, 1, 1.0]
    df = st.swing_points(frame(spark, [(h, float(h), h - 0.5, h) for h in map(float, highs)]), 2)
    assert [(i, v) for i, v in enumerate(column(df, "swing_high")) if v is not None] == [(5, 9.0)]
    assert column(df, "swing_high_i")[5] == 3


def test_gaps_mitigation_inversion(spark):
    bars = [(100.0, 101.0, 99.5, 100.5), (101.0, 104.0, 100.8, 103.5), (103.5, 106.0, 102.0, 105.0), (105.0, 105.5, 103.0, 103.2), (103.0, 103.5, 100.0, 100.4)]
    df = frame(spark, bars).withColumn("atr", F.lit(None).cast("double"))
    gaps = z.gaps(df)
    assert [tuple(r) for r in gaps.collect()] == [("A", "bullish", 102.0, 101.0, 2)]
    assert z.mitigated(gaps, df, ["symbol", "created_i"]).first()["mitigated_i"] == 4
    assert [tuple(r) for r in z.inverted(gaps, df).collect()] == [("A", "bearish", 102.0, 101.0, 4, 2)]
    assert close(column(z.distance_to_nearest(df.withColumn("atr", F.lit(2.0)), gaps, "d"), "d"), [None, None, 1.5, 0.6, 0.3])


def test_labels(spark):
    flat = [(100.0, 100.1, 99.9, 100.0)] * 12
    at = lambda bars, side: column(triple_barrier(frame(spark, bars).withColumn("atr", F.lit(1.0)), 2.0, 1.0, 2, F.lit(side)), "label")
    up = flat[:2] + [(100.0, 103.0, 99.9, 100.0)] + flat[3:]
    assert at(up, "long")[:2] == [1, 1] and at(up, "short")[:2] == [-1, -1]
    both = flat[:1] + [(100.0, 103.0, 98.0, 100.0)] + flat[2:]
    assert at(both, "long")[0] == -1
    assert at(flat, "long") == [0] * 10 + [None] * 2


@pytest.mark.parametrize("seed,limit,gaps", [(1, 0.2, 0.0), (2, 0.02, 0.0), (3, 0.02, 0.05)])
def test_backtest_matches_a_loop(spark, seed, limit, gaps):
    cfg = Config()
    cfg = dataclasses.replace(cfg, risk=dataclasses.replace(cfg.risk, max_drawdown_pct=limit), labeling=dataclasses.replace(cfg.labeling, horizon=6))
    rng, bars = random.Random(seed), noise(300, seed)
    bars = [(o, None, None, c) if rng.random() < gaps else (o, h, lo, c) for o, h, lo, c in bars]
    signals = [(rng.choice(["long", "short"]), 2.0, 3.0) if rng.random() < 0.4 else None for _ in bars]
    probs = [None if rng.random() < 0.1 else rng.random() for _ in bars]
    tradable = set(range(40, 150)) | set(range(180, 290))
    extra = spark.createDataFrame([(i, s[0] if s else "none", s[1] if s else None, s[2] if s else None, p, i in tradable, "ifvg") for i, (s, p) in enumerate(zip(signals, probs))], "i long, direction string, stop_dist double, target_dist double, probability double, tradable boolean, entry_type string")
    trades, curve, summary = bt.backtest(frame(spark, bars).join(extra, "i"), cfg)
    want, marks, halted = loops.backtest(bars, signals, probs, tradable, cfg)
    got = [(r.entry_i, r.exit_i, r.exit_reason) for r in trades.orderBy("entry_i").collect()]
    assert got == [t[:3] for t in want]
    assert close([r.net_pnl for r in trades.orderBy("entry_i").collect()], [t[3] for t in want])
    assert close(column(curve, "equity"), marks)
    assert summary.first()["halted"] == halted
    m = metrics(curve, trades, summary).first().asDict()
    assert m["num_trades"] == len(want) and math.isclose(m["final_equity"], marks[-1], rel_tol=1e-9)
    assert report(m).count("\n") == len(m) - 1 and f"num trades: {len(want)}" in report(m)


def test_no_trades_give_zeros(spark):
    df = frame(spark, of_closes([1.0] * 5)).withColumns({"direction": F.lit("none"), "stop_dist": F.lit(1.0), "target_dist": F.lit(1.0), "probability": F.lit(1.0), "tradable": F.lit(True), "entry_type": F.lit("none")})
    trades, curve, summary = bt.backtest(df, Config())
    m = metrics(curve, trades, summary).first()
    assert (m.num_trades, m.sharpe, m.max_drawdown, m.final_equity, m.profit_factor) == (0, 0.0, 0.0, 10000.0, 0.0)


def test_sizes_and_costs(spark):
    row = spark.range(1).select(position_size(F.lit(10000.0), F.lit(0.01), F.lit(5.0), F.lit(10.0)), position_size(F.lit(1e6), F.lit(0.5), F.lit(1.0), F.lit(1.0)), position_size(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)), net_pnl(F.lit(0.0), F.lit(0.3), F.lit(7.0), F.lit(1.0))).first()
    assert [round(x, 9) for x in row] == [0.2, 1.0, 0.0, -37.0]


def test_folds_are_purged(spark):
    sizes = lambda n: spark.createDataFrame([("A", n)], "symbol string, n long")
    rows = fd.walk_forward(sizes(2000), 500, 200, 10, 24).collect()
    assert rows and all(r.train_hi <= r.test_lo - 24 and r.test_hi <= 2000 for r in rows)
    rolling = fd.walk_forward(sizes(1500), 400, 150, 20, 24, "rolling").collect()
    assert all(r.train_hi - r.train_lo == 400 for r in rolling)
    assert fd.walk_forward(sizes(10), 500, 200, 10, 24).count() == 0


def test_matrix_is_causal(spark):
    cfg = Config()
    df = sample_bars(spark, rows=220, seed=5)

    def at(n, i):
        part = df.filter(F.col("i") < n)
        s, zones = ft.with_signals(ft.base(part, cfg), cfg)
        return ft.feature_matrix(s, cfg, zones).filter(F.col("i") == i).first()

    a, b = at(220, 150), at(151, 150)
    assert len(ft.feature_names(cfg)) == 60
    assert close([a[n] for n in ft.feature_names(cfg)], [b[n] for n in ft.feature_names(cfg)])


def test_model_learns_and_scores(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = np.where(x[:, 0] > 0, 1, -1)
    m = md.fit(x, y, 0.2)
    assert m == md.fit(x, y, 0.2) and m["classes"] == [-1, 1]
    lit = lambda v: F.array(*[F.array(*map(F.lit, r)) if isinstance(r, list) else F.lit(r) for r in v])
    p = spark.range(1).select(md.probabilities(F.array(F.lit(2.0), F.lit(0.0)), lit(m["mean"]), lit(m["std"]), lit(m["weights"]), lit(m["bias"])).alias("p")).select(md.probability_of(1, F.col("p"), F.array(F.lit(-1), F.lit(1))), md.probability_of(0, F.col("p"), F.array(F.lit(-1), F.lit(1))), md.predicted(F.col("p"), F.array(F.lit(-1), F.lit(1)))).first()
    assert p[0] > 0.9 and p[1] == 0.0 and p[2] == 1
    assert md.fit(x, np.ones(80), 0.2)["classes"] == [1]


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("Date,O,High,L,Close,Vol,junk\n2024/01/02 10:00,1,2,0.5,1.5,3,x\n1704186000,1,2,0.5,1.5,,y\n02/01/2024,1,2,0.5,1,7,z\n2024-01-02T10:00:00,9,9,9,9,9,w\n")
    rows = read_bars(spark, str(f)).orderBy("i").collect()
    assert [(r.i, str(r.timestamp), r.close, r.volume) for r in rows] == [(0, "2024-01-02 00:00:00", 1.0, 7.0), (1, "2024-01-02 09:00:00", 1.5, 0.0), (2, "2024-01-02 10:00:00", 1.5, 3.0)]
    for bad in ("2024-01-01,1,1,2,1", "2024-01-01,-1,1,-1,1", "2024-01-01,5,2,1,1", "2024-01-01,x,2,1,1", "never,1,1,1,1"):
        f.write_text(f"time,open,high,low,close\n{bad}\n")
        with pytest.raises(BadBars):
            read_bars(spark, str(f))
        assert read_bars(spark, str(f), strict=False).count() == 0
    f.write_text("open,high\n1,2\n")
    with pytest.raises(BadBars):
        read_bars(spark, str(f))


def test_sample_source(spark, tmp_path):
    df = sample_bars(spark, rows=900, symbols=2)
    rows = df.filter("symbol = 'SAMPLE'").orderBy("i").collect()
    assert df.count() == 1800 and rows[0].open == 2000.0 and all(a.close == b.open for a, b in zip(rows, rows[1:]))
    assert all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) and 1000 < r.low < r.high < 4000 for r in rows)
    assert rows == sample_bars(spark, rows=900, symbols=5).repartition(7).filter("symbol = 'SAMPLE'").orderBy("i").collect()
    assert rows != sample_bars(spark, rows=900, seed=8).orderBy("i").collect()
    write_bars(df.filter("symbol = 'SAMPLE'"), str(tmp_path / "out"))
    assert read_bars(spark, str(tmp_path / "out"), strict=False).count() == 900


def test_one_row_of_the_matrix(spark):
    m = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 2.0), ("B", 1, 3.0)], "symbol string, i long, x double")
    assert [r.x for r in ft.row(m, "A", 1).collect()] == [2.0] and ft.row(m, "A", 9).count() == 0


def test_config_guard_and_broker(spark, tmp_path):
    assert from_dict({"features": {"atr_window": 20}, "labeling": {"atr_window": 20}, "odd": 1}).features.atr_window == 20
    with pytest.raises(ValueError):
        from_dict({"features": {"atr_window": 20}})
    (tmp_path / "c.yaml").write_text("features:\n  ema_windows: [3, 4]\n  ict:\n    primary_entry: fvg\n")
    assert load_config(str(tmp_path / "c.yaml")).features.ema_windows == (3, 4)
    live = from_dict({"execution": {"live_trading_enabled": True, "mode": "LIVE"}})
    assert live_allowed(live) and not live_allowed(Config()) and not live_allowed(from_dict({"execution": {"live_trading_enabled": True}}))
    with pytest.raises(OrdersDisabled):
        route_order(Config(), None)
    with pytest.raises(NotImplementedError):
        route_order(live, None)
    with pytest.raises(Exception, match='not available here'):
        fetch_bars(spark, "X").collect()
    assert fetch_window(None, "2024-01-10", 3) == ("2024-01-07T00:00:00", "2024-01-10") and fetch_window("a", "b", None) == ("a", "b")
    assert bar_count("D1", T0, T0 + timedelta(days=10)) == 22 and bar_count("M1", T0, T0 + timedelta(days=9999)) == 400_000
