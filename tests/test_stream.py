import random
import tempfile

from pyspark.sql import functions as F
from test_bars import SCHEMA, frame, noise

from tickloom.config import Config
from tickloom.operators import backtest as bt
from tickloom.sources.bars import bars
from tickloom.streaming.paper import opened, paper_fills, step
from tickloom.streaming.ticks import stream_bars


def test_stream_bars_match_batch(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    args = (F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))
    folder = tempfile.mkdtemp(prefix="spark-test-")
    batch.repartition(1).write.mode("overwrite").parquet(folder)
    q = stream_bars(spark.readStream.schema(batch.schema).parquet(folder), *args).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("streamed"), bars(batch, *args).drop("i")
    assert got.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0
    assert want.count() - got.count() < 20  # the last intervals are still open


def test_paper_stream_matches_rules_and_backtest(spark):
    cfg, rng = Config(), random.Random(8)
    raw = noise(120, 8)
    df = frame(spark, raw)
    more = spark.createDataFrame([(i, rng.choice(["long", "short", "none"]), 2.0, 3.0, rng.random(), "fvg") for i in range(120)], "i long, direction string, stop_dist double, target_dist double, probability double, entry_type string")
    rows = df.join(more, "i").select("symbol", "i", "high", "low", "close", "direction", "stop_dist", "target_dist", "probability", "entry_type", F.lit(None).cast("string").alias("control"))
    book, fills = opened(cfg), []
    for r in rows.orderBy("i").collect():
        book, fill = step(book, r.asDict(), cfg)
        if fill:
            fills.append((fill["entry_i"], fill["exit_i"], fill["exit_reason"], round(fill["net_pnl"], 6)))
    folder = tempfile.mkdtemp(prefix="spark-test-")
    for lo in (0, 60):
        rows.filter(F.col("i").between(lo, lo + 59)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    q = paper_fills(stream, cfg).writeStream.format("memory").queryName("fills").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [(r.entry_i, r.exit_i, r.exit_reason, round(r.net_pnl, 6)) for r in spark.table("fills").orderBy("entry_i", "exit_i").collect()]
    assert got == fills and len(fills) > 3
    trades, _, _ = bt.backtest(df.join(more, "i").withColumn("tradable", F.lit(True)), cfg)
    batch = [(r.entry_i, r.exit_i, r.exit_reason, round(r.net_pnl, 6)) for r in trades.orderBy("entry_i").collect()]
    assert got == batch[: len(got)] and len(batch) <= len(got) + 1  # the batch closes what is open at the end


def test_forced_close_and_late_bars():
    cfg = Config()
    book, fill = step(opened(cfg), {"i": 5, "high": 1.0, "low": 1.0, "close": 1.0, "direction": "long", "stop_dist": 1.0, "target_dist": 1.0, "probability": 1.0}, cfg)
    assert fill is None and book.open.entry_price == 1.0
    assert step(book, {"i": 5, "high": 9.0, "low": 0.0, "close": 1.0}, cfg) == (book, None)
    closed, fill = step(book, {"i": 6, "close": 1.5, "control": "close"}, cfg)
    assert fill["exit_reason"] == "forced" and fill["exit_price"] == 1.5 and closed.open is None
    assert step(closed, {"i": 7, "close": 1.5, "control": "close"}, cfg) == (closed, None)


def events_in_order(spark, folder, until=None):
    """The small table's ticks in four files by time, and then one tick of another symbol far ahead, which closes all intervals."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "value", "event_id")
    cut = [r.t for r in e.select(F.expr("percentile_approx(cast(ts as timestamp), array(0.3, 0.5, 0.8)) as t")).collect()][0]
    edges = [None, *cut, None]
    for lo, hi in zip(edges, edges[1:]):
        part = e if lo is None else e.filter(F.col("ts") >= lo.isoformat(sep=" "))
        part = part if hi is None else part.filter(F.col("ts") < hi.isoformat(sep=" "))
        part.coalesce(1).write.mode("append").parquet(folder)
    last = e.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit("clock").alias("event_type"), "ts", F.lit(1.0).alias("value"), F.lit(10**9).cast("long").alias("event_id"))
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_ticks_to_fills_as_the_batch(spark):
    """The same fills from a stream of ticks as from the batch over all bars, symbol by symbol."""
    from tickloom.config import from_dict
    from tickloom.operators import features as ft
    from tickloom.operators import indicators as ind
    from tickloom.sources.bars import event_bars
    from tickloom.streaming.desk import desk_fills

    cfg = from_dict({"risk": {"max_drawdown_pct": 1e9}, "backtest": {"prob_threshold": 0.4}})
    batch = ft.with_signals(ft.base(event_bars(spark, "/root/testdata/sf0.001"), cfg), cfg)[0]
    batch = ind.rsi(batch).withColumn("probability", F.col("rsi") / 100).withColumn("tradable", F.lit(True))
    trades = bt.backtest(batch, cfg)[0]
    last = {r.symbol: r.i for r in batch.groupBy("symbol").agg(F.max("i").alias("i")).collect()}
    told = lambda r: (r.symbol, r.entry_i, r.exit_i, r.direction, r.exit_reason, r.entry_type, round(r.lots, 6), round(r.net_pnl, 6))
    want = sorted(told(r) for r in trades.collect())
    ticks = events_in_order(spark, tempfile.mkdtemp(prefix="spark-test-"))
    bars_ = stream_bars(ticks, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))
    got = sorted(told(r) for r in run(desk_fills(bars_, cfg), "desk").collect())
    closed = [t for t in want if not (t[2] == last[t[0]] and t[4] == "time")]  # the batch closes what is open at the end
    assert [t for t in got if t in closed] == closed and len(closed) > 20 and len(got) - len(closed) <= 5


def test_a_quiet_symbol_is_closed_by_a_timer(spark):
    from tickloom.config import from_dict
    from tickloom.streaming.desk import desk_fills

    cfg = from_dict({"risk": {"max_drawdown_pct": 1e9}, "backtest": {"prob_threshold": 0.0}, "labeling": {"horizon": 10_000, "stop_atr_mult": 1000.0, "target_atr_mult": 1000.0}})
    ticks = events_in_order(spark, tempfile.mkdtemp(prefix="spark-test-"))
    bars_ = stream_bars(ticks, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))
    fills = run(desk_fills(bars_, cfg, quiet_s=10 * 86400), "quiet").collect()
    assert fills and {r.exit_reason for r in fills} == {"forced"}
    assert len({r.symbol for r in fills}) == len(fills) and all(r.exit_i > r.entry_i for r in fills)


def test_a_desk_is_what_the_batch_finds(spark):
    """Bar by bar, nulls included, and through its written form: averages, bias and signals."""
    from tickloom.operators import features as ft
    from tickloom.operators import indicators as ind
    from tickloom.streaming import desk as dk

    cfg = Config()
    for seed, gaps in ((3, ()), (4, (60, 61, 90)), (5, (7,))):
        raw = [b if k not in gaps else (b[0], None, None, b[3]) for k, b in enumerate(noise(160, seed))]
        batch = ind.rsi(ft.with_signals(ft.base(frame(spark, raw), cfg), cfg)[0]).orderBy("i").collect()
        d = dk.desk(cfg)
        for row, (o, h, lo, c) in zip(batch, raw):
            d = dk.loaded(dk.dumped(d))
            got = dk.advance(d, {"open": o, "high": h, "low": lo, "close": c}, cfg, dk.by_rsi)
            for name in ("atr", "rsi"):
                assert (got[name] is None) == (row[name] is None) and (got[name] is None or abs(got[name] - row[name]) < 1e-8), (seed, row.i, name)
            assert (got["i"], got["ms_bias"], got["direction"], got["entry_type"]) == (row.i, row.ms_bias, row.direction, row.entry_type), (seed, row.i)
