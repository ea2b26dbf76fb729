"""The registered queries over the given tables, and their SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.candles import patterns, sessions
from .functions.series import clamp, diff, divide, lagged, over, rolling_max, rolling_mean, rolling_min, rolling_std, to_number
from .operators import backtest as bt
from .operators import boosting
from .operators import features as ft
from .operators import folds as fd
from .operators import indicators as ind
from .operators import model as md
from .operators import structure as st
from .operators import zones as z
from .operators.labels import triple_barrier
from .operators.metrics import bar_returns, drawdowns, metrics
from .operators.risk import net_pnl, position_size
from .operators.scan import ewm
from .oracles import sql
from .plans.research import prepared
from .sources.bars import bars, event_bars, order_bars
from .sources.csv import checked, read_bars, unique
from .staging import kept, shared_dir

CFG = Config()
KEY = ("symbol", "i")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*KEY, *[r6(n) for n in names])


def _r(*pairs: str) -> str:
    """'x' or 'x name' as rounded columns."""
    return ", ".join(f"round({p.split()[0]}, 6) AS {p.split()[-1]}" for p in pairs)


# ---------------------------------------------------------------- bars and series


@query(f"SELECT symbol, i, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS time, {_r('open', 'high', 'low', 'close', 'volume')} FROM bars")
def ohlcv_bars(spark: SparkSession, d: str) -> DataFrame:
    b = event_bars(spark, d)
    return b.select(*KEY, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), *[r6(c) for c in ("open", "high", "low", "close", "volume")])


@query("""SELECT 'orders' AS symbol, row_number() OVER (ORDER BY o_orderdate::DATE) - 1 AS i, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day, round(arg_min(o_totalprice, o_orderkey), 6) AS open, round(max(o_totalprice), 6) AS high,
    round(min(o_totalprice), 6) AS low, round(arg_max(o_totalprice, o_orderkey), 6) AS close, count(*) AS n FROM orders GROUP BY o_orderdate::DATE""")
def bars_daily_orders(spark: SparkSession, d: str) -> DataFrame:
    b = order_bars(spark, d)
    return b.select(*KEY, F.date_format("timestamp", "yyyy-MM-dd").alias("day"), *[r6(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("n"))


@query("""SELECT symbol, i, round(close - lag(close, 2) OVER w, 6) AS diff2, round(CASE WHEN i >= 4 THEN avg(close) OVER f END, 6) AS mean5, round(CASE WHEN i >= 4 THEN stddev_samp(close) OVER f END, 6) AS std5, round(CASE WHEN i >= 4 THEN stddev_pop(close) OVER f END, 6) AS pop5,
    round(CASE WHEN i >= 4 THEN max(close) OVER f END, 6) AS max5, round(CASE WHEN i >= 4 THEN min(close) OVER f END, 6) AS min5, round(close / nullif(open, 0), 6) AS ratio, round(greatest(10, least(100, close)), 6) AS clamped, round(lag(close, 3) OVER w, 6) AS lag3
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def series_kernels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    found = {"diff2": diff(c, 2), "mean5": rolling_mean(c, 5), "std5": rolling_std(c, 5), "pop5": rolling_std(c, 5, 0), "max5": rolling_max(c, 5), "min5": rolling_min(c, 5), "ratio": divide(c, F.col("open")), "clamped": clamp(c, 10, 100), "lag3": lagged(c, 3)}
    return rounded(over(event_bars(spark, d).withColumn("close", to_number(F.col("close").cast("string"))), 4, lambda b: b.withColumns(found)), *found)


@query(f"SELECT symbol, i, {_r('ret_1', 'ret_5', 'ret_10')} FROM ret")
def simple_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.returns(event_bars(spark, d), (1, 5, 10)), "ret_1", "ret_5", "ret_10")


@query(f"SELECT symbol, i, {_r('logret_1', 'logret_5', 'logret_10')} FROM ret")
def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.returns(event_bars(spark, d), (1, 5, 10)), "logret_1", "logret_5", "logret_10")


@query(f"SELECT symbol, i, {_r('volatility')} FROM vol")
def rolling_volatility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.volatility(event_bars(spark, d)), "volatility")


@query("SELECT symbol, i, round(CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) AS sma_20 FROM bars")
def sma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.sma(event_bars(spark, d), 20), "sma_20")


@query(f"SELECT symbol, i, {_r('e9 ema_9', 'e21 ema_21', 'e50 ema_50', 'e200 ema_200')} FROM osc")
def ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.ema(event_bars(spark, d), (9, 21, 50, 200)), "ema_9", "ema_21", "ema_50", "ema_200")


@query("""SELECT b.symbol, b.i, round((SELECT sum(x.close * power(0.8, b.i - x.i)) / sum(power(0.8, b.i - x.i)) FROM bars x WHERE x.symbol = b.symbol AND x.i <= b.i), 6) AS ewm_adjusted FROM bars b""")
def ewm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm(event_bars(spark, d), "ewm_adjusted", F.col("close"), alpha=0.2, adjust=True), "ewm_adjusted")


@query(f"SELECT symbol, i, {_r('rsi')} FROM osc")
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.rsi(event_bars(spark, d)), "rsi")


@query(f"SELECT symbol, i, {_r('macd', 'macd_signal', 'macd_hist')} FROM osc")
def macd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.macd(event_bars(spark, d)), "macd", "macd_signal", "macd_hist")


@query(f"SELECT symbol, i, {_r('tr')} FROM tr")
def true_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.true_range(event_bars(spark, d)), "tr")


@query(f"SELECT symbol, i, {_r('atr')} FROM osc")
def atr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.atr(event_bars(spark, d)), "atr")


@query(f"SELECT symbol, i, {_r('mid bb_mid', 'upper bb_upper', 'lower bb_lower', 'pctb bb_pctb', 'bandwidth bb_bandwidth')} FROM boll")
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.bollinger(event_bars(spark, d)), "bb_mid", "bb_upper", "bb_lower", "bb_pctb", "bb_bandwidth")


@query(f"SELECT symbol, i, {_r('hi rolling_high', 'lo rolling_low', 'pos channel_pos')} FROM chan")
def channel_position(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.channel(event_bars(spark, d)), "rolling_high", "rolling_low", "channel_pos")


# ---------------------------------------------------------------- candles, structure, zones


@query(f"SELECT symbol, i, {_r('body_ratio', 'upper_wick_ratio', 'lower_wick_ratio', 'candle_range')} FROM pat")
def candle_geometry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(over(event_bars(spark, d), 1, lambda b: b.withColumns(patterns())), "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "candle_range")


@query("SELECT symbol, i, is_doji, is_hammer, is_shooting_star FROM pat")
def doji_hammer_star(spark: SparkSession, d: str) -> DataFrame:
    return over(event_bars(spark, d), 1, lambda b: b.withColumns(patterns())).select(*KEY, "is_doji", "is_hammer", "is_shooting_star")


@query("SELECT symbol, i, is_bullish_engulfing, is_bearish_engulfing FROM pat")
def engulfing(spark: SparkSession, d: str) -> DataFrame:
    return over(event_bars(spark, d), 1, lambda b: b.withColumns(patterns())).select(*KEY, "is_bullish_engulfing", "is_bearish_engulfing")


@query("SELECT symbol, i, in_london, in_newyork_am, in_killzone FROM kz")
def killzones(spark: SparkSession, d: str) -> DataFrame:
    flags = sessions(CFG.features.ict.killzones)
    return event_bars(spark, d).withColumns(flags).select(*KEY, *flags)


@query("""SELECT symbol, i, hour(timestamp) BETWEEN 0 AND 2 AS in_asia, hour(timestamp) BETWEEN 17 AND 19 AS in_newyork_pm, false AS in_sydney, hour(timestamp) BETWEEN 0 AND 2 OR hour(timestamp) BETWEEN 17 AND 19 AS in_killzone FROM bars""")
def killzones_other(spark: SparkSession, d: str) -> DataFrame:
    """The zones that are off by default, and one that there is not."""
    flags = sessions(("asia", "newyork_pm", "sydney"))
    return event_bars(spark, d).withColumns(flags).select(*KEY, *flags)


@query("SELECT symbol, i, round(pd_position, 6) AS pd_position, pd_position > 0.5 AS premium FROM pd")
def premium_discount(spark: SparkSession, d: str) -> DataFrame:
    return st.premium_discount(event_bars(spark, d)).select(*KEY, r6("pd_position"), "premium")


@query(f"SELECT symbol, i, {_r('sh swing_high', 'sl swing_low')}, CASE WHEN sh IS NOT NULL THEN i - 5 END AS swing_high_i, CASE WHEN sl IS NOT NULL THEN i - 5 END AS swing_low_i FROM swing")
def swing_points(spark: SparkSession, d: str) -> DataFrame:
    return st.swing_points(event_bars(spark, d)).select(*KEY, r6("swing_high"), r6("swing_low"), "swing_high_i", "swing_low_i")


@query(f"SELECT symbol, i, bias AS ms_bias, bos AS ms_bos, choch AS ms_choch, {_r('last_sh last_swing_high', 'last_sl last_swing_low')} FROM ms")
def market_structure(spark: SparkSession, d: str) -> DataFrame:
    return st.market_structure(event_bars(spark, d)).select(*KEY, "ms_bias", "ms_bos", "ms_choch", r6("last_swing_high"), r6("last_swing_low"))


@query("SELECT symbol, i, since_bos AS bars_since_bos, since_choch AS bars_since_choch FROM ms")
def bars_since_events(spark: SparkSession, d: str) -> DataFrame:
    return st.market_structure(event_bars(spark, d)).select(*KEY, "bars_since_bos", "bars_since_choch")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return ft.base(event_bars(spark, d), CFG)


def _zone(df: DataFrame, *more: str) -> DataFrame:
    return df.select("symbol", "type", r6("top"), r6("bottom"), "created_i", *more)


_ZONE = "symbol, type, round(top, 6) AS top, round(bottom, 6) AS bottom, created_i"


@query(f"SELECT {_ZONE} FROM fvg")
def fvg(spark: SparkSession, d: str) -> DataFrame:
    return _zone(z.gaps(_base(spark, d)))


@query(f"SELECT {_ZONE}, mitigated_i FROM fvgm")
def fvg_mitigation(spark: SparkSession, d: str) -> DataFrame:
    df = _base(spark, d)
    return _zone(z.mitigated(kept(z.gaps(df)), df, ["symbol", "created_i"]), "mitigated_i")


@query(f"SELECT {_ZONE}, source_i FROM ifvg")
def ifvg(spark: SparkSession, d: str) -> DataFrame:
    df = _base(spark, d)
    return _zone(z.inverted(kept(z.gaps(df)), df), "source_i")


@query(f"SELECT {_ZONE}, source_i FROM ob")
def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _zone(st.order_blocks(_base(spark, d)), "source_i")


@query(f"SELECT symbol, i, {_r('bs buyside_level', 'ss sellside_level')} FROM liq")
def liquidity_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.liquidity(_base(spark, d)), "buyside_level", "sellside_level")


@query("SELECT symbol, i, bsw AS buyside_sweep, ssw AS sellside_sweep FROM sweep")
def liquidity_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return st.liquidity(_base(spark, d)).select(*KEY, "buyside_sweep", "sellside_sweep")


@query("SELECT b.symbol, b.i, round(dist_to_fvg, 6) AS dist_to_fvg, round(dist_to_ifvg, 6) AS dist_to_ifvg FROM bars b LEFT JOIN zdist USING (symbol, i)")
def dist_to_zone(spark: SparkSession, d: str) -> DataFrame:
    df = _base(spark, d)
    gaps = kept(z.gaps(df))
    found = z.distances(df.select("symbol", "i", "close", "atr"), {"dist_to_fvg": gaps, "dist_to_ifvg": kept(z.inverted(gaps, df))})
    df = df.join(found, ["symbol", "i"], "left")
    return rounded(df, "dist_to_fvg", "dist_to_ifvg")


# ---------------------------------------------------------------- signals, labels, folds, features


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return ft.with_signals(_base(spark, d), CFG)[0]


@query(f"SELECT symbol, i, direction, entry_type, {_r('close entry_price', 'stop_dist', 'target_dist', 'zone_top', 'zone_bottom')} FROM sigs")
def signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(*KEY, "direction", "entry_type", *[r6(c) for c in ("entry_price", "stop_dist", "target_dist", "zone_top", "zone_bottom")])


@query("""SELECT symbol, i, CASE type WHEN 'bullish' THEN 'long' ELSE 'short' END AS direction, kind AS entry_type, round(top, 6) AS zone_top, round(bottom, 6) AS zone_bottom FROM hits
    QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY CASE kind WHEN 'fvg' THEN 0 WHEN 'ifvg' THEN 1 ELSE 2 END, source_i) = 1""")
def signals_fvg_first(spark: SparkSession, d: str) -> DataFrame:
    """The signals of another primary trigger."""
    cfg = replace(CFG, features=replace(CFG.features, ict=replace(CFG.features.ict, primary_entry="fvg")))
    found = ft.with_signals(_base(spark, d), cfg)[0].filter("direction != 'none'")
    return found.select(*KEY, "direction", "entry_type", r6("zone_top"), r6("zone_bottom"))


@query("SELECT symbol, direction, entry_type, count(*) AS n FROM sigs GROUP BY ALL")
def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).groupBy("symbol", "direction", "entry_type").agg(F.count(F.lit(1)).alias("n"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    lab = CFG.labeling
    return triple_barrier(_signals(spark, d), lab.target_atr_mult, lab.stop_atr_mult, lab.horizon, F.col("direction"))


@query("SELECT b.symbol, b.i, label, horizon_used FROM bars b LEFT JOIN lab USING (symbol, i)")
def triple_barrier_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(*KEY, "label", "horizon_used")


@query("SELECT symbol, label, count(*) AS n, round(avg(horizon_used), 6) AS mean_horizon FROM lab GROUP BY ALL")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).filter("label is not null").groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("horizon_used"), "mean_horizon"))


@query("""SELECT c.symbol, c.i, coalesce(arg_min(CASE WHEN b.high >= c.close + c.atr THEN -1 ELSE 1 END, b.i), 0) AS label, coalesce(min(b.i) - c.i, 12) AS horizon_used
    FROM sale c LEFT JOIN bars b ON b.symbol = c.symbol AND b.i BETWEEN c.i + 1 AND c.i + 12 AND (b.high >= c.close + c.atr OR b.low <= c.close - 1.5 * c.atr) GROUP BY c.symbol, c.i""")
def triple_barrier_short(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a sale at every bar, other barriers and horizon."""
    found = triple_barrier(kept(ind.atr(event_bars(spark, d))), 1.5, 1.0, 12, F.lit(" Sell "))
    return found.filter("label is not null").select(*KEY, "label", "horizon_used")


@query("""SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY k) - 1 AS fold, greatest(0, k * 60) AS train_lo, 200 + k * 60 AS train_hi, 224 + k * 60 AS test_lo, 284 + k * 60 AS test_hi
    FROM ends, (SELECT unnest(range(0, 2000)) AS k) WHERE 284 + k * 60 <= n""")
def walk_forward_rolling(spark: SparkSession, d: str) -> DataFrame:
    return fd.walk_forward(event_bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), 200, 60, 10, 24, "rolling")


@query("SELECT symbol, fold, train_lo, train_hi, test_lo, test_hi FROM folds")
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    return fd.adaptive(event_bars(spark, d), CFG)


@query("SELECT b.symbol, f.fold, p.part, count(*) AS n, min(b.i) AS first_i, max(b.i) AS last_i FROM bars b JOIN folds f USING (symbol), (VALUES ('train'), ('test')) p(part) WHERE CASE p.part WHEN 'train' THEN b.i >= train_lo AND b.i < train_hi ELSE b.i >= test_lo AND b.i < test_hi END GROUP BY ALL")
def fold_membership(spark: SparkSession, d: str) -> DataFrame:
    b = event_bars(spark, d)
    return fd.members(b, fd.adaptive(b, CFG)).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


NAMES = ft.feature_names(CFG)
_LACKS = " OR ".join(f"{n} IS NULL" for n in NAMES)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return ft.feature_matrix(*(lambda s: (s[0], CFG, s[1]))(ft.with_signals(_base(spark, d), CFG)))


@query(f"SELECT symbol, i, round(close, 6) AS close, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, ({_LACKS}) AS warmup FROM lags")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select(*KEY, r6("close"), *[r6(n) for n in NAMES], "warmup")


@query(f"SELECT symbol, count(*) AS bars, count(*) FILTER ({_LACKS}) AS warmup_bars, min(i) FILTER (NOT ({_LACKS})) AS first_whole FROM lags GROUP BY symbol")
def warmup_summary(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(F.col("warmup"), 1)).alias("warmup_bars"), F.min(F.when(~F.col("warmup"), F.col("i"))).alias("first_whole"))


# ---------------------------------------------------------------- model, risk, backtest

#: A model with set coefficients for the query that checks scoring: three classes over three features.
_FIXED = {"classes": (-1, 0, 1), "mean": (50.0, 0.5, 0.0), "std": (10.0, 0.25, 0.0), "weights": ((0.3, -0.2, 0.1), (0.0, 0.1, -0.4), (-0.25, 0.35, 0.2)), "bias": (0.1, -0.1, 0.05)}
_LOGIT = [f"greatest(-30, least(30, {b} + {w[0]} * (coalesce(rsi, 0) - 50) / 10 + {w[1]} * (coalesce(pctb, 0) - 0.5) / 0.25 + {w[2]} * coalesce(ret_1, 0)))" for w, b in zip(_FIXED["weights"], _FIXED["bias"])]


@query(f"SELECT symbol, i, round(p1, 6) AS p_target, CASE WHEN pm >= p0 AND pm >= p1 THEN -1 WHEN p0 >= p1 THEN 0 ELSE 1 END AS predicted FROM (SELECT symbol, i, exp(a) / (exp(a) + exp(b) + exp(c)) AS pm, exp(b) / (exp(a) + exp(b) + exp(c)) AS p0, exp(c) / (exp(a) + exp(b) + exp(c)) AS p1 FROM (SELECT o.symbol, o.i, {_LOGIT[0]} AS a, {_LOGIT[1]} AS b, {_LOGIT[2]} AS c FROM osc o JOIN boll USING (symbol, i) JOIN ret USING (symbol, i)))")
def model_score(spark: SparkSession, d: str) -> DataFrame:
    df = ind.returns(ind.bollinger(ind.rsi(event_bars(spark, d))), (1,))
    lit = lambda v: F.array(*[F.array(*map(F.lit, x)) if isinstance(x, tuple) else F.lit(x) for x in v])
    proba = md.probabilities(ft.vector(["rsi", "bb_pctb", "ret_1"]), lit(_FIXED["mean"]), lit(_FIXED["std"]), lit(_FIXED["weights"]), lit(_FIXED["bias"]))
    df = df.withColumn("_p", proba)
    return df.select(*KEY, r6(md.probability_of(1, F.col("_p"), lit(_FIXED["classes"])), "p_target"), md.predicted(F.col("_p"), lit(_FIXED["classes"])).alias("predicted"))


@query(None)
def model_train(spark: SparkSession, d: str) -> DataFrame:
    df, matrix = prepared(event_bars(spark, d), CFG)
    folds = fd.adaptive(df, CFG)
    return md.train(matrix, folds, NAMES, CFG).select("symbol", "fold", F.size("classes").alias("classes"), r6(F.aggregate(F.flatten("weights"), F.lit(0.0), lambda a, w: a + F.abs(w)), "weight"), F.transform("bias", lambda b: F.round(b, 6)).alias("bias"))


@query(None)
def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each fold's model trained and its test bars scored; folds without a model give 1."""
    df, matrix = prepared(event_bars(spark, d), CFG)
    folds, matrix = kept(fd.adaptive(df, CFG)), kept(matrix)
    return md.score(matrix, folds, kept(md.train(matrix, folds, NAMES, CFG)), NAMES).select(*KEY, r6("probability"))


# Three features of a bar and whether the next one closes higher, for the queries that train with few steps.
_SMALL = ("rsi", "bb_pctb", "ret_1")
_UP = """up AS (SELECT symbol, i, (lead(bars.close) OVER (PARTITION BY symbol ORDER BY i) > bars.close)::INTEGER AS y, rsi AS x1, pctb AS x2, ret_1 AS x3
    FROM bars JOIN osc USING (symbol, i) JOIN boll USING (symbol, i) JOIN ret USING (symbol, i))"""


def _next_up(spark: SparkSession, d: str) -> DataFrame:
    df = ind.returns(ind.bollinger(ind.rsi(event_bars(spark, d))), (1,))
    ahead = df.select("symbol", (F.col("i") - 1).alias("i"), F.col("close").alias("_next"))
    return df.join(ahead, ["symbol", "i"], "left").withColumn("label", (F.col("_next") > F.col("close")).cast("int")).drop("_next").withColumn("warmup", F.col("rsi").isNull() | F.col("bb_pctb").isNull() | F.col("ret_1").isNull())


def _descent_sql(steps: int, rate: float, seed: int = 42) -> str:
    """A descent for two classes, step by step: each step is one grouped pass over the rows."""
    rng = random.Random(seed)
    w = [[rng.uniform(-0.01, 0.01) for _ in _SMALL] for _ in range(2)]
    cols = [f"{'wb'[j == 3]}{k}{j}" for k in range(2) for j in range(4)]
    ctes = [
        "rows_ AS (SELECT u.*, f.fold FROM up u JOIN folds f ON u.symbol = f.symbol AND u.i >= train_lo AND u.i < train_hi WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)",
        "stats AS (SELECT symbol, fold, count(*) AS n, count(DISTINCT y) AS classes, " + ", ".join(f"avg(x{j}) AS m{j}, CASE WHEN stddev_pop(x{j}) > 1e-12 THEN stddev_pop(x{j}) ELSE 1 END AS s{j}" for j in (1, 2, 3)) + " FROM rows_ GROUP BY ALL)",
        "z AS (SELECT symbol, fold, y, n, " + ", ".join(f"(x{j} - m{j}) / s{j} AS z{j - 1}" for j in (1, 2, 3)) + ", 1.0 AS z3 FROM rows_ JOIN stats USING (symbol, fold) WHERE classes = 2 AND n >= 10)",
        "step0 AS (SELECT DISTINCT symbol, fold, " + ", ".join(f"{w[k][j] if j < 3 else 0.0!r}::DOUBLE AS {'wb'[j == 3]}{k}{j}" for k in range(2) for j in range(4)) + " FROM z)",
    ]
    for t in range(steps):
        logit = [f"greatest(-30, least(30, {' + '.join(f'{chr(98 if j == 3 else 119)}{k}{j} * z{j}' for j in range(4))}))" for k in range(2)]
        ctes.append(f"err{t} AS (SELECT z.*, {', '.join(f'exp(l{k}) / (exp(l0) + exp(l1)) - (y = {k})::INTEGER AS e{k}' for k in range(2))} FROM (SELECT z.*, {', '.join(f'{v} AS l{k}' for k, v in enumerate(logit))} FROM z JOIN step{t} USING (symbol, fold)) z)")
        ctes.append(f"grad{t} AS (SELECT symbol, fold, {', '.join(f'sum(e{k} * z{j}) / max(n) AS g{k}{j}' for k in range(2) for j in range(4))} FROM err{t} GROUP BY ALL)")
        ctes.append(f"step{t + 1} AS (SELECT symbol, fold, {', '.join(f'{c} - {rate} * (g{c[1:]}{f' + 0.001 * {c}' if c[0] == chr(119) else ''}) AS {c}' for c in cols)} FROM step{t} JOIN grad{t} USING (symbol, fold))")
    return f"SELECT * FROM (WITH {_UP}, {', '.join(ctes)} SELECT symbol, fold, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM step{steps})"


@query(_descent_sql(5, 0.2))
def model_descent(spark: SparkSession, d: str) -> DataFrame:
    """Five steps of the descent for two classes, over blocks of 128 bars."""
    df = _next_up(spark, d)
    rows = md.training_rows(df, fd.adaptive(df, CFG), list(_SMALL))
    m = md.train_rows(rows, 0.2, steps=5, block=128)
    return m.select("symbol", "fold", *[r6(F.col("weights")[k][j], f"w{k}{j}") for k in range(2) for j in range(3)], *[r6(F.col("bias")[k], f"b{k}3") for k in range(2)])


@query(f"""SELECT * FROM (WITH {_UP}, points AS (SELECT symbol, floor(x1) / 100 AS s, sum(y) AS hits, count(*) AS n FROM up WHERE y IS NOT NULL AND x1 IS NOT NULL GROUP BY ALL),
    run AS (SELECT symbol, s, sum(hits) OVER w AS h, sum(n) OVER w AS m, coalesce(sum(hits) OVER p, 0) AS h0, coalesce(sum(n) OVER p, 0) AS m0 FROM points WINDOW w AS (PARTITION BY symbol ORDER BY s), p AS (PARTITION BY symbol ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    least_ AS (SELECT x.symbol, x.s, a.s AS start, min((b.h - a.h0)::DOUBLE / (b.m - a.m0)) AS v FROM run x JOIN run a ON a.symbol = x.symbol AND a.s <= x.s JOIN run b ON b.symbol = x.symbol AND b.s >= x.s GROUP BY ALL),
    fitted AS (SELECT symbol, s, max(v) AS v FROM least_ GROUP BY ALL)
    SELECT symbol, round(min(s), 6) AS lo, round(max(s), 6) AS hi, round(v, 6) AS rate FROM fitted GROUP BY symbol, v)""")
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How often the next bar closes higher, by RSI, as rates that never fall: pools of the calibration that boosted models use."""
    df = _next_up(spark, d).filter("label is not null and rsi is not null")
    points = df.groupBy("symbol", F.lit(0).alias("fold"), F.lit(0).alias("tree"), (F.floor("rsi") / 100).alias("score")).agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    pools = boosting.curves(points.withColumn("rows", F.lit(boosting.LEAST_ISOTONIC).cast("long")))
    pool = F.explode(F.arrays_zip("lo", "hi", "value")).alias("p")
    return pools.select("symbol", pool).select("symbol", r6("p.lo", "lo"), r6("p.hi", "hi"), r6("p.value", "rate"))


@query(None)
def boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boosted and calibrated models of each fold, with few trees, and the probabilities of its test bars."""
    df = _next_up(spark, d)
    cfg = replace(CFG, model=replace(CFG.model, n_estimators=20, learning_rate=0.2, max_depth=3))
    folds = kept(fd.adaptive(df, cfg))
    return boosting.score(df, folds, kept(boosting.train(df, folds, list(_SMALL), cfg)), list(_SMALL)).select(*KEY, r6("probability"))


@query("SELECT symbol, i, round(CASE WHEN atr > 0 THEN least(0.01 * 10000 / (atr * 100), 1) ELSE 0 END, 6) AS lots FROM osc")
def position_sizing(spark: SparkSession, d: str) -> DataFrame:
    r = CFG.risk
    lots = position_size(F.lit(CFG.backtest.initial_capital), F.lit(r.risk_per_trade), F.col("atr") * r.atr_stop_mult, F.lit(r.max_position_lots))
    return ind.atr(event_bars(spark, d)).select(*KEY, r6(lots, "lots"))


@query("SELECT symbol, i, round((close - open) * 100 * volume / 10 - 0.2 * 100 * volume / 10 - 6 * volume / 10, 6) AS net FROM bars")
def trade_costs(spark: SparkSession, d: str) -> DataFrame:
    lots = F.col("volume") / 10
    net = net_pnl((F.col("close") - F.col("open")) * 100 * lots, F.lit(CFG.backtest.spread_pips / 100), F.lit(CFG.backtest.commission_per_lot), lots)
    return event_bars(spark, d).select(*KEY, r6(net, "net"))


def _backtest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The RSI stands in for the model's probability here, so that SQL can follow; the window is that of the folds."""
    df = ind.rsi(_signals(spark, d)).withColumn("probability", F.col("rsi") / 100)
    span = fd.adaptive(df, CFG).groupBy("symbol").agg(F.min("test_lo").alias("_a"), F.max("test_hi").alias("_z"))
    df = df.join(span, "symbol").withColumn("tradable", (F.col("i") >= F.col("_a")) & (F.col("i") < F.col("_z"))).drop("_a", "_z")
    return bt.backtest(kept(df), CFG)


@query(f"SELECT symbol, e AS entry_i, exit_i, direction, {_r('entry_price', 'exit_price', 'lots', 'gross gross_pnl', 'net net_pnl')}, exit_reason, entry_type FROM trades")
def backtest_trades(spark: SparkSession, d: str) -> DataFrame:
    t = _backtest(spark, d)[0]
    return t.select("symbol", "entry_i", "exit_i", "direction", *[r6(c) for c in ("entry_price", "exit_price", "lots", "gross_pnl", "net_pnl")], "exit_reason", "entry_type")


@query("SELECT symbol, i, round(equity, 6) AS equity, in_market FROM curve")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    return _backtest(spark, d)[1].select(*KEY, r6("equity"), "in_market")


@query("SELECT symbol, i, round(ret, 6) AS ret, round(peak, 6) AS peak, peak_i, round(dd, 6) AS dd FROM dd")
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return drawdowns(bar_returns(_backtest(spark, d)[1])).select(*KEY, r6("ret"), r6("peak"), "peak_i", r6("dd"))


@query("""SELECT symbol, 10000.0::DOUBLE AS initial_capital, round(10000 + coalesce(net, 0), 6) AS final_equity, round((10000 + coalesce(net, 0)) / 10000 - 1, 6) AS total_return,
    round(CASE WHEN 10000 + coalesce(net, 0) > 0 AND years > 0 THEN power((10000 + coalesce(net, 0)) / 10000, 1 / years) - 1 ELSE 0 END, 6) AS cagr, 24192 AS bars_per_year,
    round(CASE WHEN std > 0 THEN mean / std * sqrt(24192) ELSE 0 END, 6) AS sharpe, round(mdd, 6) AS max_drawdown, CASE WHEN mdd > 0 THEN mdur ELSE 0 END AS max_drawdown_duration, coalesce(num_trades, 0) AS num_trades,
    round(coalesce(wins / num_trades, 0), 6) AS win_rate, round(coalesce(avg_win, 0), 6) AS avg_win, round(coalesce(avg_loss, 0), 6) AS avg_loss, round(CASE WHEN lost > 0 THEN coalesce(profit, 0) / lost WHEN profit > 0 THEN 'infinity'::DOUBLE ELSE 0 END, 6) AS profit_factor,
    round(exposure, 6) AS exposure, symbol IN (SELECT symbol FROM stopped) AS halted
  FROM (SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS std, max(dd) AS mdd, arg_max(i - peak_i, dd * 1e9 - i * 1e-9) AS mdur, avg(in_market::INTEGER) AS exposure FROM dd GROUP BY symbol)
  JOIN (SELECT symbol, (epoch(max(timestamp)) - epoch(min(timestamp))) / 31557600.0 AS years FROM dd GROUP BY symbol) USING (symbol)
  LEFT JOIN (SELECT symbol, sum(net) AS net, count(*) AS num_trades, count(*) FILTER (net > 0) AS wins, avg(net) FILTER (net > 0) AS avg_win, avg(net) FILTER (net < 0) AS avg_loss, sum(net) FILTER (net > 0) AS profit, -sum(net) FILTER (net < 0) AS lost FROM trades GROUP BY symbol) t USING (symbol)""")
def performance(spark: SparkSession, d: str) -> DataFrame:
    trades, curve, summary = _backtest(spark, d)
    m = metrics(curve, trades, summary)
    whole = ("symbol", "bars_per_year", "max_drawdown_duration", "num_trades", "halted")
    return m.select(*[c if c in whole else r6(c) for c in m.columns])


# ---------------------------------------------------------------- cleaning


@query("""SELECT coalesce(CASE WHEN ts IS NULL THEN 'time' WHEN value IS NULL THEN 'number' WHEN value * 0.9 > value THEN 'high below low' WHEN value < 0 THEN 'negative' WHEN user_id % 7 = 0 AND value * 1.2 > value * 1.1 THEN 'open or close outside the range' END, 'ok') AS status,
    count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def csv_clean(spark: SparkSession, d: str) -> DataFrame:
    """Events as the text of a file with odd headers; every seventh user's close lies above its high."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = lambda k: (F.col("value") * k).cast("string")
    raw = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd HH:mm:ss").alias(" Date "), text(1.0).alias("O"), text(1.1).alias("High"), text(0.9).alias("l"), F.when(F.col("user_id") % 7 == 0, text(1.2)).otherwise(text(1.0)).alias("close"), F.lit("").alias("tick_volume"), F.col("event_id").alias("place"))
    rows = checked(raw, F.col("place"))
    return rows.groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("open"), 4).alias("total"))


@query("""SELECT 'FILE' AS symbol, row_number() OVER (ORDER BY date_trunc('hour', ts)) - 1 AS i, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS time, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high,
    round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*)::DOUBLE AS volume FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY date_trunc('hour', ts)""")
def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """Bars of all events, written as CSV files with odd headers, times day first and spaces around, and read back."""
    e = spark.read.parquet(f"{d}/events.parquet")
    made = bars(e, F.lit("all"), F.col("ts"), F.col("value"), F.col("event_id"))
    text = made.select(F.date_format("timestamp", " dd/MM/yyyy HH:mm:ss").alias("Date"), F.lit("x").alias("note"), F.concat(F.lit(" "), F.col("open")).alias("O"), F.col("high").alias("H"), F.col("low").alias("Low"), F.col("close").alias("Adj Close"), F.col("volume").cast("long").alias("TickVol"))
    folder = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    text.repartition(4, "Date").write.csv(folder, header=True, ignoreLeadingWhiteSpace=False)
    back = read_bars(spark, folder, "FILE")
    return back.select(*KEY, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), *[r6(c) for c in ("open", "high", "low", "close", "volume")])


@query("SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS time, min(event_id) AS kept, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY ALL")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("_at"), "value")
    return unique(e).select("symbol", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("_at").alias("kept"), r6("value"))
