"""Command line: run (or backtest), make-sample, fetch-mt5."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .config import Config, load_config
from .operators.metrics import report
from .plans.research import backend, research
from .session import session
from .sources.broker import fetch_bars, fetch_window
from .sources.csv import read_bars, write_bars
from .sources.sinks import write_equity, write_metrics
from .sources.walk import walk_bars


def load(spark: SparkSession, cfg: Config, path: str | None, sample: bool) -> DataFrame:
    path = path or cfg.data.csv_path
    if sample or not ("://" in path or os.path.exists(path)):
        rows = max(cfg.backtest.train_size + cfg.backtest.test_size + cfg.labeling.horizon + 50, 700)
        return walk_bars(spark, rows=rows, seed=7, symbol=cfg.data.symbol)
    return read_bars(spark, path, cfg.data.symbol)


def run(args: argparse.Namespace) -> int:
    cfg, spark = load_config(args.config) if args.config else Config(), session()
    out = args.out or os.path.join("runs", datetime.now().strftime("%Y%m%d_%H%M%S"))
    r = research(load(spark, cfg, args.data, args.sample), cfg)
    for row in r.metrics.orderBy("symbol").toLocalIterator():
        print(report(row.asDict()))
    write_metrics(r.metrics, f"{out}/metrics")
    write_equity(r.curve, f"{out}/equity_curve")
    backend(cfg).save(r.models, f"{out}/models")
    return 0


def make_sample(args: argparse.Namespace) -> int:
    write_bars(walk_bars(session(), rows=args.rows, seed=args.seed), args.out)
    return 0


def fetch(args: argparse.Namespace) -> int:
    start, end = fetch_window(args.start, args.end, args.days)
    write_bars(fetch_bars(session(), args.symbol, args.timeframe, start, end), args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "backtest"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--data")
        s.add_argument("--sample", action="store_true")
        s.add_argument("--out")
        s.set_defaults(do=run)
    s = sub.add_parser("make-sample")
    s.add_argument("--out", default="data/sample/bars.csv")
    s.add_argument("--rows", type=int, default=300)
    s.add_argument("--seed", type=int, default=7)
    s.set_defaults(do=make_sample)
    s = sub.add_parser("fetch-mt5")
    for name, default in (("symbol", "SAMPLE"), ("timeframe", "M15"), ("start", None), ("end", None), ("out", "data/mt5_candles.csv")):
        s.add_argument(f"--{name}", default=default)
    s.add_argument("--days", type=int)
    s.set_defaults(do=fetch)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.do(args)
