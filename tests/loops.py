"""Plain loops over one series, written from the definitions, that the DataFrame operators are held against."""

from __future__ import annotations


def ema(xs, a):
    out, y = [], None
    for x in xs:
        if x is not None:
            y = x if y is None else a * x + (1 - a) * y
        out.append(y)
    return out


def atr(bars, w=14):
    tr = []
    for k, (_, h, lo, _) in enumerate(bars):
        pc = bars[k - 1][3] if k else None
        tr.append(None if h is None or lo is None else max([h - lo] + ([abs(h - pc), abs(lo - pc)] if pc is not None else [])))
    out, n = [None] * len(tr), len(tr)
    if n <= w:
        return out
    if None in tr[1 : w + 1]:
        return [sum(tr[k - w + 1 : k + 1]) / w if k >= w - 1 and None not in tr[k - w + 1 : k + 1] else None for k in range(n)]
    out[w] = sum(tr[1 : w + 1]) / w
    for k in range(w + 1, n):
        out[k] = out[k - 1] if tr[k] is None else (out[k - 1] * (w - 1) + tr[k]) / w
    return out


def backtest(bars, signals, probs, tradable, cfg):
    """Bars (o, h, l, c), signals (direction, stop, target) or None. Trades as (entry, exit, reason, net), and the curve."""
    b, r, horizon = cfg.backtest, cfg.risk, cfg.labeling.horizon
    equity = peak = b.initial_capital
    pos, trades, curve, halted = None, [], [], False
    days = sorted(tradable)

    def net(price):
        return (price - pos["p"]) * pos["s"] * 100 * pos["n"] - (b.spread_pips + b.commission_per_lot) * pos["n"]

    for i in range(days[0], days[-1] + 1):
        _, h, lo, c = bars[i]
        if pos and h is not None and lo is not None:
            long = pos["s"] > 0
            out = ("stop", pos["stop"]) if (lo <= pos["stop"] if long else h >= pos["stop"]) else ("target", pos["target"]) if (h >= pos["target"] if long else lo <= pos["target"]) else ("time", c) if i - pos["i"] >= horizon else None
            if out:
                equity += net(out[1])
                trades.append((pos["i"], i, out[0], net(out[1])))
                pos = None
        marked = equity + (net(c) if pos else 0)
        curve.append(marked)
        peak = max(peak, marked)
        halted = halted or (peak - marked) / peak >= r.max_drawdown_pct
        if pos is None and i in tradable and not halted and signals[i] and probs[i] is not None and probs[i] >= b.prob_threshold:
            side, stop, target = signals[i]
            lots = min(r.risk_per_trade * equity / (stop * 100), r.max_position_lots) if equity > 0 else 0
            if lots > 0:
                s = 1 if side == "long" else -1
                pos = {"i": i, "p": c, "s": s, "n": lots, "stop": c - s * stop, "target": c + s * target}
    if pos:
        equity += net(bars[days[-1]][3])
        trades.append((pos["i"], days[-1], "time", net(bars[days[-1]][3])))
        curve[-1] = equity
    return trades, curve, halted
