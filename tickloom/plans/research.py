"""The research run: bars to features, signals, labels, folds, model, backtest, metrics."""

from __future__ import annotations

from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import backtest as bt
from ..operators import boosting
from ..operators import features as ft
from ..operators import folds as fd
from ..operators import model as md
from ..operators.labels import triple_barrier
from ..operators.metrics import metrics
from ..staging import kept


@dataclass
class Research:
    matrix: DataFrame
    folds: DataFrame
    models: DataFrame
    probabilities: DataFrame
    trades: DataFrame
    curve: DataFrame
    summary: DataFrame
    metrics: DataFrame


def prepared(bars: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Bars with signals and labels, and the feature matrix with label."""
    df, zones = ft.with_signals(ft.base(bars, cfg), cfg)
    df = kept(triple_barrier(df, cfg.labeling.target_atr_mult, cfg.labeling.stop_atr_mult, cfg.labeling.horizon, F.col("direction")))
    return df, ft.feature_matrix(df, cfg, zones).join(df.select("symbol", "i", "label"), ["symbol", "i"])


def backend(cfg: Config) -> ModuleType:
    """Boosted trees for model_type lightgbm, else the logistic model; both have train, score, save and load."""
    return boosting if cfg.model.model_type == "lightgbm" else md


def research(bars: DataFrame, cfg: Config) -> Research:
    """What several steps need is written once to the shared folder. The test bars of all folds form one window a symbol, over which equity carries on."""
    df, matrix = prepared(bars, cfg)
    matrix = kept(matrix)
    names = ft.feature_names(cfg)
    folds = kept(fd.adaptive(df, cfg))
    kind = backend(cfg)
    models = kept(kind.train(matrix, folds, names, cfg))
    p = kind.score(matrix, folds, models, names)
    traded = df.join(p.withColumn("tradable", F.lit(True)), ["symbol", "i"], "left").withColumn("tradable", F.coalesce("tradable", F.lit(False)))
    trades, curve, summary = bt.backtest(kept(traded), cfg)
    return Research(matrix, folds, models, p, trades, curve, summary, metrics(curve, trades, summary))
