"""Real orders: allowed only if asked for twice, and then still not built."""

from __future__ import annotations

from ..config import Config


class OrdersDisabled(RuntimeError):
    pass


def live_allowed(cfg: Config) -> bool:
    return cfg.execution.live_trading_enabled is True and str(cfg.execution.mode).strip().lower() == "live"


def require_live(cfg: Config) -> None:
    if not live_allowed(cfg):
        raise OrdersDisabled("real orders need execution.live_trading_enabled: true and execution.mode: live; both are off by default")


def route_order(cfg: Config, order: object) -> None:
    """Refuses always: there is no way from here to a broker."""
    require_live(cfg)
    raise NotImplementedError("no order path is built")
