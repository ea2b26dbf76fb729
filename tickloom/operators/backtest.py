"""Set-based backtest. Each possible entry's exit depends on that entry alone, so all exits come from one interval join; pointers from exits to next entries pick those
that are taken, and scans over blocks mark the equity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import series
from ..staging import kept
from .intervals import matches
from .risk import CONTRACT, breached, net_pnl
from .scan import carried

#: Bars are numbered back from here where a search runs from the end.
TURN = 1 << 40


def _sign() -> Column:
    return F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)


def entries(df: DataFrame, cfg: Config) -> DataFrame:
    """All bars that could open a trade, with its exit. df: signals, probability and tradable (the test bars); the window runs from its first tradable bar to its last."""
    b, h = cfg.backtest, cfg.labeling.horizon
    threshold = 0.5 if b.prob_threshold is None else b.prob_threshold
    span = df.filter("tradable").groupBy("symbol").agg(F.max("i").alias("last_i"))
    last = df.join(span, "symbol").filter("i = last_i").select("symbol", "last_i", F.col("close").alias("last_close"))
    e = df.filter((F.col("tradable")) & F.col("direction").isin("long", "short") & (F.col("stop_dist") > 0) & F.col("close").isNotNull() & (F.col("probability") >= threshold))
    e = e.select("symbol", F.col("i").alias("entry_i"), "direction", F.col("close").alias("entry_price"), "stop_dist", "entry_type", (F.col("close") - _sign() * F.col("stop_dist")).alias("stop"), F.when(F.col("target_dist") != 0, F.col("close") + _sign() * F.col("target_dist")).alias("target")).join(last, "symbol")
    # bars from the horizon on close at any bar whose range is known; bars of unknown range close nothing, so the first known one may lie beyond the horizon
    ranged = df.filter("high is not null and low is not null").select("symbol", "i", "high", "low", "close")
    long = F.col("direction") == "long"
    stopped = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    reached = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    due = F.col("i") - F.col("entry_i") >= h
    exit_ = F.when(stopped, F.struct("i", F.lit("stop").alias("reason"), F.col("stop").alias("price"))).when(reached, F.struct("i", F.lit("target").alias("reason"), F.col("target").alias("price"))).when(due, F.struct("i", F.lit("time").alias("reason"), F.col("close").alias("price")))
    first = F.min(exit_).alias("x")
    near = matches(e, ranged, F.col("entry_i") + 1, F.least(F.col("entry_i") + h, F.col("last_i"))).groupBy("symbol", "entry_i").agg(first)
    late = e.join(near.filter("x is not null"), ["symbol", "entry_i"], "left_anti").filter(F.col("entry_i") + h < F.col("last_i"))
    after = matches(late, ranged, F.col("entry_i") + h + 1, F.col("last_i")).groupBy("symbol", "entry_i").agg(first) if _has_gaps(df) else None
    exits = near.filter("x is not null")
    exits = exits.unionByName(after) if after is not None else exits
    e = e.join(exits, ["symbol", "entry_i"], "left")
    forced = F.col("x").isNull()
    return e.select(
        "symbol", "entry_i", "direction", "entry_price", "stop_dist", "entry_type", forced.alias("forced"), F.coalesce("x.i", "last_i").alias("exit_i"), F.coalesce("x.reason", F.lit("time")).alias("exit_reason"),
        F.coalesce("x.price", F.when(forced, F.col("last_close")), "entry_price").alias("exit_price"),
    )


def _has_gaps(df: DataFrame) -> bool:
    return not df.filter("high is null or low is null").isEmpty()


def take(possible: DataFrame, cfg: Config) -> DataFrame:
    """The entries that are taken: one position at a time, sized by realised equity. A trade may open on the bar that closes the one before.

    Which entry follows one depends on its exit alone, so the taken ones are a chain of pointers: next_entries() sets them, chained() follows them within blocks of bars and then
    doubles jumps from block to block. Lots depend on the equity so far: a block of trades is a map of equity, linear by pieces, and sized() puts these maps, a row a
    block, in order. Equity that is not above zero opens nothing more."""
    if min(cfg.risk.risk_per_trade, cfg.risk.max_position_lots) <= 0:
        return possible.filter("false").withColumns({c: F.lit(0.0) for c in ("lots", "gross_pnl", "net_pnl")})
    pointed = kept(next_entries(possible))
    return possible.join(sized(chained(pointed), cfg), ["symbol", "entry_i"])


def next_entries(possible: DataFrame) -> DataFrame:
    """symbol, entry_i, next_i (the first possible entry at the exit or later; null after a forced exit or if there is none), and what sizes need. A search in order from the end:
    exits ask, entries answer."""
    move = _sign() * (F.col("exit_price") - F.col("entry_price"))
    e = kept(possible.select("symbol", "entry_i", "exit_i", "forced", "stop_dist", move.alias("move")))
    # entries and asking exits stand in one line, numbered from the last bar on; at one bar entries come first
    at = lambda bar: F.lit(TURN) - F.col(bar)
    asks = e.filter("not forced").select("symbol", at("exit_i").alias("i"), "entry_i", F.lit(None).cast("long").alias("answer"))
    answers = e.select("symbol", at("entry_i").alias("i"), F.lit(None).cast("long").alias("entry_i"), F.col("entry_i").alias("answer"))
    told = asks.unionByName(answers).groupBy("symbol", "i").agg(F.max("answer").alias("answer"))
    found = asks.drop("answer").join(carried(told, {"next_i": ("last", F.col("answer"), 0)}), ["symbol", "i"]).select("symbol", "entry_i", "next_i")
    return e.join(found, ["symbol", "entry_i"], "left")


def chained(pointed: DataFrame) -> DataFrame:
    """The entries of the chain from each symbol's first entry on, by block: symbol, block, entry_i, stop_dist, move."""
    packs = kept(pointed.withColumn("block", F.floor(F.col("entry_i") / series.WIDTH)))
    lands = kept(packs.groupBy("symbol", "block").applyInArrow(_landed, "symbol string, gate long, jump long"))
    reached = kept(pointed.groupBy("symbol").agg(F.min("entry_i").alias("gate")))
    jumps = lands.filter("jump is not null")
    while True:  # each round doubles how many blocks the chain from the first gate reaches
        more = reached.join(jumps, ["symbol", "gate"]).select("symbol", F.col("jump").alias("gate"))
        new = kept(more.join(reached, ["symbol", "gate"], "left_anti").distinct())
        if new.isEmpty():
            break
        reached = kept(reached.unionByName(new))
        onward = jumps.select(F.col("symbol"), F.col("gate").alias("jump"), F.col("jump").alias("_far"))
        jumps = kept(jumps.join(onward, ["symbol", "jump"]).select("symbol", "gate", F.col("_far").alias("jump")))
    gates = reached.select("symbol", F.floor(F.col("gate") / series.WIDTH).alias("block"), "gate")
    return packs.join(gates, ["symbol", "block"]).groupBy("symbol", "block").applyInArrow(_followed, "symbol string, block long, entry_i long, stop_dist double, move double")


def _ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's entries in order, and of each the place of the next one in the block, or its own entry_i if that is beyond (-1: none)."""
    rows = rows.sort_by("entry_i")
    entry, to = rows.column("entry_i").to_numpy(), rows.column("next_i").fill_null(-1).to_numpy()
    place = np.searchsorted(entry, to)
    return rows, np.where((to >= 0) & (to <= entry[-1]), place, -1), to


def _landed(rows: pa.Table) -> pa.Table:
    """gate, jump: of each entry of a block the entry beyond the block that its chain comes to; of entries with one next only the first is ever a gate, so all are told."""
    rows, inside, to = _ordered(rows)
    jump = to.copy()
    for k in range(len(to) - 1, -1, -1):
        if inside[k] >= 0:
            jump[k] = jump[inside[k]]
    return pa.table({"symbol": rows.column("symbol"), "gate": rows.column("entry_i"), "jump": pa.array(jump, mask=jump < 0)})


def _followed(rows: pa.Table) -> pa.Table:
    """The entries of a block on the chain from its gate."""
    rows, inside, _ = _ordered(rows)
    k, chain = int(np.searchsorted(rows.column("entry_i").to_numpy(), rows.column("gate")[0].as_py())), []
    while k >= 0:
        chain.append(k)
        k = int(inside[k])
    return rows.take(pa.array(chain)).select(["symbol", "block", "entry_i", "stop_dist", "move"])


def _opened(equity: float, stop: float, move: float, cfg: Config) -> tuple[float, float, float]:
    """Lots, gross and net result of a trade that equity opens."""
    lots = min(cfg.risk.risk_per_trade * equity / (stop * CONTRACT), cfg.risk.max_position_lots) if equity > 0 else 0.0
    return lots, move * CONTRACT * lots, (move * CONTRACT - cfg.backtest.spread_pips / 100.0 * CONTRACT - cfg.backtest.commission_per_lot) * lots


def mapped(pieces: list[tuple[float, float, float]], stop: float, move: float, cfg: Config) -> list[tuple[float, float, float]]:
    """A map of equity with one more trade after it. A map is pieces (from, a, b): from there on, up to the next piece, equity e becomes a e + b. It begins at 0: what is not above
    zero stays as it is."""
    per_lot = move * CONTRACT - cfg.backtest.spread_pips / 100.0 * CONTRACT - cfg.backtest.commission_per_lot
    rate = cfg.risk.risk_per_trade / (stop * CONTRACT)
    full = cfg.risk.max_position_lots / rate  # from this equity on the size is capped
    out: list[tuple[float, float, float]] = []
    for k, (lo, a, b) in enumerate(pieces):
        hi = pieces[k + 1][0] if k + 1 < len(pieces) else math.inf
        cuts = sorted({lo, *(x for level in (0.0, full) if a and lo < (x := (level - b) / a) < hi)})
        for x, y in zip(cuts, [*cuts[1:], hi]):
            middle = a * ((x + y) / 2 if y < math.inf else 2 * x + 1) + b
            new = (a, b) if middle <= 0 else (a, b + per_lot * cfg.risk.max_position_lots) if middle >= full else (a * (1 + rate * per_lot), b * (1 + rate * per_lot))
            if not out or out[-1][1:] != new:
                out.append((x, *new))
    return out


def sized(chain: DataFrame, cfg: Config) -> DataFrame:
    """symbol, entry_i, lots, gross_pnl, net_pnl of the chain's entries that equity opens. chain: of chained()."""

    def maps(rows: pa.Table) -> pa.Table:
        rows, pieces = rows.sort_by("entry_i"), [(0.0, 1.0, 0.0)]
        for stop, move in zip(rows.column("stop_dist").to_pylist(), rows.column("move").to_pylist()):
            pieces = mapped(pieces, stop, move, cfg)
        lo, a, b = zip(*pieces)
        return pa.table({"symbol": rows.column("symbol").slice(0, 1), "block": rows.column("block").slice(0, 1), **{n: pa.array([list(v)], pa.list_(pa.float64())) for n, v in (("lo", lo), ("a", a), ("b", b))}})

    def starts(rows: pa.Table) -> pa.Table:
        rows, equity, out = rows.sort_by("block"), cfg.backtest.initial_capital, []
        for lo, a, b in zip(*(rows.column(c).to_pylist() for c in ("lo", "a", "b"))):
            out.append(equity)
            if equity > 0:
                k = int(np.searchsorted(lo, equity, "right")) - 1
                equity = a[k] * equity + b[k]
        return pa.table({"symbol": rows.column("symbol"), "block": rows.column("block"), "equity": pa.array(out, pa.float64())})

    def trades(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("entry_i"), []
        equity = rows.column("equity")[0].as_py()
        for stop, move in zip(rows.column("stop_dist").to_pylist(), rows.column("move").to_pylist()):
            out.append(_opened(equity, stop, move, cfg))
            equity += out[-1][2]
        made = pa.table({"symbol": rows.column("symbol"), "entry_i": rows.column("entry_i"), **{n: pa.array(v, pa.float64()) for n, v in zip(("lots", "gross_pnl", "net_pnl"), zip(*out))}})
        return made.filter(pc.greater(made.column("lots"), 0))

    chain = kept(chain)
    by_block = kept(chain.groupBy("symbol", "block").applyInArrow(maps, "symbol string, block long, lo array<double>, a array<double>, b array<double>"))
    before = by_block.groupBy("symbol").applyInArrow(starts, "symbol string, block long, equity double")  # a row a block
    return chain.join(before, ["symbol", "block"]).groupBy("symbol", "block").applyInArrow(trades, "symbol string, entry_i long, lots double, gross_pnl double, net_pnl double")


def curve(df: DataFrame, trades: DataFrame, cfg: Config) -> DataFrame:
    """symbol, i, timestamp, equity, in_market of each bar of the window: realised equity and the open position at its close, net of costs."""
    b = cfg.backtest
    span = df.filter("tradable").groupBy("symbol").agg(F.min("i").alias("_a"), F.max("i").alias("_z"))
    bars = df.join(span, "symbol").filter("i between _a and _z").select("symbol", "i", "timestamp", "close", "_z")
    booked = trades.groupBy("symbol", F.col("exit_i").alias("i")).agg(F.sum(F.when(~F.col("forced"), F.col("net_pnl"))).alias("booked"), F.sum("net_pnl").alias("final"), F.max("forced").alias("any_forced"))
    # a forced trade is open up to the last bar, where its net result overwrites the mark; one that opens there leaves its costs
    open_ = matches(trades.select("symbol", "entry_i", "exit_i", "forced", "direction", "entry_price", "lots"), bars.select("symbol", "i", "close"), F.col("entry_i") + 1, F.when(F.col("forced"), F.col("exit_i")).otherwise(F.col("exit_i") - 1))
    gross = _sign() * (F.col("close") - F.col("entry_price")) * CONTRACT * F.col("lots")
    mark = F.when(F.col("close").isNotNull(), net_pnl(gross, F.lit(b.spread_pips / 100.0), F.lit(b.commission_per_lot), F.col("lots"))).otherwise(0.0)
    open_ = open_.select("symbol", "i", mark.alias("mark"))
    out = bars.join(booked, ["symbol", "i"], "left").join(open_, ["symbol", "i"], "left").withColumn("in_market", F.col("mark").isNotNull())
    out = carried(out, {"_booked": ("sum", F.col("booked"), 0), "_final": ("sum", F.col("final"), 0)})
    realised, total = (F.lit(b.initial_capital) + F.coalesce(c, F.lit(0.0)) for c in ("_booked", "_final"))
    forced = (F.col("i") == F.col("_z")) & F.coalesce("any_forced", F.lit(False))
    equity = realised + F.coalesce("mark", F.lit(0.0))
    return out.withColumns({"marked": equity, "equity": F.when(forced, total).otherwise(equity)}).select("symbol", "i", "timestamp", "marked", "equity", "in_market")


def guarded(curve_: DataFrame, cfg: Config) -> DataFrame:
    """symbol, breach_i: the first bar whose marked equity is max_drawdown_pct below the peak so far (the initial capital at least)."""
    peaks = carried(curve_, {"_peak": ("max", F.col("marked"), 0)})
    return peaks.withColumn("_peak", F.greatest(F.lit(cfg.backtest.initial_capital), "_peak")).filter(breached(F.col("marked"), F.col("_peak"), cfg.risk.max_drawdown_pct)).groupBy("symbol").agg(F.min("i").alias("breach_i"))


def backtest(df: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades, equity curve and summary (symbol, final_equity, halted, bars_in_market, total_bars, initial_capital).

    The guard latches: from its breach on nothing opens. What was open then runs on, and the equity before does not depend on it, so the breach is found on the
    unguarded curve and the later trades are dropped. df: signals (direction, stop_dist, target_dist, entry_type), probability and tradable."""
    all_trades = kept(take(kept(entries(df, cfg)), cfg))
    stops = kept(guarded(curve(df, all_trades, cfg), cfg))
    trades = all_trades.join(stops, "symbol", "left").filter("breach_i is null or entry_i < breach_i").drop("breach_i")
    marked = kept(curve(df, trades, cfg))
    halted = stops.select("symbol", F.lit(True).alias("halted"))
    booked = trades.groupBy("symbol").agg(F.sum("net_pnl").alias("_net"))
    summary = marked.groupBy("symbol").agg(F.sum(F.col("in_market").cast("long")).alias("bars_in_market"), F.count(F.lit(1)).alias("total_bars"))
    summary = summary.join(booked, "symbol", "left").join(halted, "symbol", "left").select("symbol", (F.lit(cfg.backtest.initial_capital) + F.coalesce("_net", F.lit(0.0))).alias("final_equity"), F.coalesce("halted", F.lit(False)).alias("halted"), "bars_in_market", "total_bars", F.lit(cfg.backtest.initial_capital).alias("initial_capital"))
    trades = trades.select("symbol", "entry_i", "exit_i", "direction", "entry_price", "exit_price", "lots", "gross_pnl", "net_pnl", "exit_reason", "entry_type")
    return trades, marked.select("symbol", "i", "timestamp", "equity", "in_market"), summary
