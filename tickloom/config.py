"""Typed configuration: nested dataclasses, read from a mapping or a YAML file. Unknown keys are passed over, missing ones keep their default."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Zones:
    enabled: bool = True
    swing_lookback: int = 5
    fvg_min_gap_atr: float = 0.25
    order_block_lookback: int = 20
    liquidity_lookback: int = 50
    equal_level_tol_atr: float = 0.1
    killzones: tuple[str, ...] = ("london", "newyork_am")
    primary_entry: str = "ifvg"
    ifvg_enabled: bool = True
    ifvg_retest_atr_tol: float = 0.15


@dataclass(frozen=True)
class Features:
    rsi_window: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    atr_window: int = 14
    bb_window: int = 20
    bb_std: float = 2.0
    ema_windows: tuple[int, ...] = (9, 21, 50, 200)
    return_windows: tuple[int, ...] = (1, 5, 10)
    ict: Zones = field(default_factory=Zones)


@dataclass(frozen=True)
class Labeling:
    horizon: int = 24
    target_atr_mult: float = 2.0
    stop_atr_mult: float = 1.0
    atr_window: int = 14


@dataclass(frozen=True)
class Model:
    """model_type lightgbm: boosted trees; any other: the logistic model, which uses learning_rate and random_state. All rows grow every tree, whatever subsample says."""

    model_type: str = "lightgbm"
    n_estimators: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    num_leaves: int = 31
    min_child_samples: int = 20
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    random_state: int = 42


@dataclass(frozen=True)
class Backtest:
    spread_pips: float = 20.0
    commission_per_lot: float = 6.0
    initial_capital: float = 10000.0
    train_size: int = 2000
    test_size: int = 500
    embargo: int = 24
    prob_threshold: float | None = 0.5


@dataclass(frozen=True)
class Risk:
    risk_per_trade: float = 0.01
    max_drawdown_pct: float = 0.20
    atr_stop_mult: float = 1.0
    max_position_lots: float = 1.0


@dataclass(frozen=True)
class Execution:
    live_trading_enabled: bool = False  # fixed value: the key's name
    mode: str = "paper"
    broker: str = "mt5"
    magic_number: int = 20240101


@dataclass(frozen=True)
class Data:
    symbol: str = "SAMPLE"
    timeframe: str = "M5"
    sample_csv: str = "data/sample/bars.csv"
    csv_path: str = "data/sample/bars.csv"


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    features: Features = field(default_factory=Features)
    labeling: Labeling = field(default_factory=Labeling)
    model: Model = field(default_factory=Model)
    backtest: Backtest = field(default_factory=Backtest)
    risk: Risk = field(default_factory=Risk)
    execution: Execution = field(default_factory=Execution)

    def __post_init__(self) -> None:
        if self.features.atr_window != self.labeling.atr_window:
            raise ValueError(f"features.atr_window ({self.features.atr_window}) and labeling.atr_window ({self.labeling.atr_window}) must be equal: labels and trades would have different barriers")


def _build(kind: type, values: Any) -> Any:
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    made = {}
    for name, value in (values or {}).items():
        if name in known:
            made[name] = _build(hints[name], value) if is_dataclass(hints[name]) else tuple(value) if isinstance(value, list) else value
    return kind(**made)


def from_dict(values: dict | None) -> Config:
    return _build(Config, values)


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))
