"""SQL for DuckDB with the meaning of each registered query, put together from named common table expressions."""

from __future__ import annotations

import re

W = "(PARTITION BY symbol ORDER BY i)"


def _w(a: str, b: str) -> str:
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {a} AND {b})"


NOW, PAST = _w("UNBOUNDED PRECEDING", "CURRENT ROW"), _w("UNBOUNDED PRECEDING", "1 PRECEDING")


def _roll(f: str, x: str, n: int) -> str:
    w = _w(f"{n - 1} PRECEDING", "CURRENT ROW")
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _ema(span: int, x: str, prev: str) -> str:
    return f"{2 / (span + 1)!r} * {x} + {1 - 2 / (span + 1)!r} * {prev}"


_SPANS = (9, 12, 21, 26, 50, 200)

CTE: dict[str, str] = {
    "bars": """SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1 AS i, date_trunc('hour', ts) AS timestamp,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
      FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)""",
    "ends": "SELECT symbol, max(i) AS z, count(*) AS n FROM bars GROUP BY symbol",
    "ret": f"""SELECT symbol, i, close, {", ".join(f"{_div(f'close - lag(close, {p}) OVER {W}', f'lag(close, {p}) OVER {W}')} AS ret_{p}, CASE WHEN close > 0 AND lag(close, {p}) OVER {W} > 0 THEN ln(close / lag(close, {p}) OVER {W}) END AS logret_{p}" for p in (1, 5, 10))} FROM bars""",
    "vol": f"SELECT symbol, i, {_roll('stddev_samp', 'ret_1', 20)} AS volatility FROM ret",
    "tr": f"""SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down
      FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars)""",
    "pre": f"""SELECT symbol, i, close, tr, coalesce(up, 0) AS up, coalesce(down, 0) AS down, avg(tr) OVER {_w("13 PRECEDING", "CURRENT ROW")} AS seed_tr,
        avg(coalesce(up, 0)) OVER {_w("13 PRECEDING", "CURRENT ROW")} AS seed_up, avg(coalesce(down, 0)) OVER {_w("13 PRECEDING", "CURRENT ROW")} AS seed_down FROM tr""",
    "rec": f"""SELECT symbol, i, {", ".join(f"close AS e{s}" for s in _SPANS)}, NULL::DOUBLE AS sig, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss, NULL::DOUBLE AS atr FROM pre WHERE i = 0
      UNION ALL SELECT b.symbol, b.i, {", ".join(_ema(s, "b.close", f"r.e{s}") for s in _SPANS)},
        CASE WHEN b.i < 25 THEN NULL WHEN b.i = 25 THEN ({_ema(12, "b.close", "r.e12")}) - ({_ema(26, "b.close", "r.e26")}) ELSE 0.2 * (({_ema(12, "b.close", "r.e12")}) - ({_ema(26, "b.close", "r.e26")})) + 0.8 * r.sig END,
        CASE WHEN b.i < 14 THEN NULL WHEN b.i = 14 THEN b.seed_up ELSE (r.gain * 13 + b.up) / 14 END, CASE WHEN b.i < 14 THEN NULL WHEN b.i = 14 THEN b.seed_down ELSE (r.loss * 13 + b.down) / 14 END,
        CASE WHEN b.i < 14 THEN NULL WHEN b.i = 14 THEN b.seed_tr ELSE (r.atr * 13 + b.tr) / 14 END
      FROM rec r JOIN pre b ON b.symbol = r.symbol AND b.i = r.i + 1""",
    "osc": """SELECT symbol, i, e9, e21, e50, e200, atr, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi, CASE WHEN i >= 25 THEN e12 - e26 END AS macd, sig AS macd_signal, CASE WHEN i >= 25 THEN e12 - e26 - sig END AS macd_hist FROM rec""",
    "boll": f"""SELECT *, mid + 2 * sd AS upper, mid - 2 * sd AS lower, {_div("close - (mid - 2 * sd)", "(mid + 2 * sd) - (mid - 2 * sd)")} AS pctb, {_div("(mid + 2 * sd) - (mid - 2 * sd)", "mid")} AS bandwidth
      FROM (SELECT symbol, i, close, {_roll("avg", "close", 20)} AS mid, {_roll("stddev_pop", "close", 20)} AS sd FROM bars)""",
    "chan": f"""SELECT *, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END AS pos FROM (SELECT symbol, i, close, {_roll("max", "high", 20)} AS hi, {_roll("min", "low", 20)} AS lo FROM bars)""",
    "geo": f"""SELECT *, high - low AS span, abs(close - open) AS body, high - greatest(open, close) AS upper, least(open, close) - low AS lower, lag(open) OVER {W} AS po, lag(close) OVER {W} AS pc FROM bars""",
    "pat": """SELECT symbol, i, CASE WHEN span > 0 THEN body / span END AS body_ratio, CASE WHEN span > 0 THEN upper / span END AS upper_wick_ratio, CASE WHEN span > 0 THEN lower / span END AS lower_wick_ratio,
        span AS candle_range, CASE WHEN span > 0 THEN body <= 0.1 * span END AS is_doji, body > 0 AND lower >= 2 * body AND upper <= body AS is_hammer, body > 0 AND upper >= 2 * body AND lower <= body AS is_shooting_star,
        CASE WHEN po IS NOT NULL THEN pc < po AND close > open AND close >= po AND open <= pc END AS is_bullish_engulfing, CASE WHEN po IS NOT NULL THEN pc > po AND close < open AND open >= pc AND close <= po END AS is_bearish_engulfing FROM geo""",
    "kz": "SELECT symbol, i, hour(timestamp) BETWEEN 7 AND 9 AS in_london, hour(timestamp) BETWEEN 12 AND 14 AS in_newyork_am, hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 12 AND 14 AS in_killzone FROM bars",
    "swing": f"""SELECT * EXCLUDE (top, bottom), lag(top, 5) OVER {W} AS sh, lag(bottom, 5) OVER {W} AS sl FROM (SELECT *,
        CASE WHEN full_ AND high > max(high) OVER {_w("5 PRECEDING", "1 PRECEDING")} AND high > max(high) OVER {_w("1 FOLLOWING", "5 FOLLOWING")} THEN high END AS top,
        CASE WHEN full_ AND low < min(low) OVER {_w("5 PRECEDING", "1 PRECEDING")} AND low < min(low) OVER {_w("1 FOLLOWING", "5 FOLLOWING")} THEN low END AS bottom
      FROM (SELECT *, count(*) OVER {_w("5 PRECEDING", "5 FOLLOWING")} = 11 AS full_ FROM bars))""",
    "brk": f"""SELECT *, coalesce(sh IS NOT NULL AND close > last_value(sh IGNORE NULLS) OVER {PAST}, false) AS up, coalesce(sl IS NOT NULL AND close < last_value(sl IGNORE NULLS) OVER {PAST}, false) AS down,
        last_value(sh IGNORE NULLS) OVER {NOW} AS last_sh, last_value(sl IGNORE NULLS) OVER {NOW} AS last_sl FROM swing""",
    "side": f"""SELECT *, coalesce(last_value(d IGNORE NULLS) OVER {PAST}, 0) AS was, coalesce(last_value(d IGNORE NULLS) OVER {NOW}, 0) AS bias FROM (SELECT *, CASE WHEN down THEN -1 WHEN up THEN 1 END AS d FROM brk)""",
    "evt": """SELECT *, CASE WHEN down AND (CASE WHEN up THEN 1 ELSE was END) < 0 THEN -1 WHEN up AND was > 0 THEN 1 ELSE 0 END AS bos, CASE WHEN down AND (CASE WHEN up THEN 1 ELSE was END) >= 0 THEN -1 WHEN up AND was <= 0 THEN 1 ELSE 0 END AS choch FROM side""",
    "ms": f"""SELECT *, i - last_value(CASE WHEN bos <> 0 OR choch <> 0 THEN i END IGNORE NULLS) OVER {NOW} AS since_bos, i - last_value(CASE WHEN choch <> 0 THEN i END IGNORE NULLS) OVER {NOW} AS since_choch FROM evt""",
    "fvg": f"""SELECT symbol, CASE WHEN h2 < low THEN 'bullish' ELSE 'bearish' END AS type, CASE WHEN h2 < low THEN low ELSE l2 END AS top, CASE WHEN h2 < low THEN h2 ELSE high END AS bottom, i AS created_i
      FROM (SELECT b.*, o.atr, lag(high, 2) OVER (PARTITION BY b.symbol ORDER BY b.i) AS h2, lag(low, 2) OVER (PARTITION BY b.symbol ORDER BY b.i) AS l2 FROM bars b JOIN osc o USING (symbol, i))
      WHERE (h2 < low AND low - h2 >= coalesce(0.25 * atr, 0)) OR (NOT h2 < low AND l2 > high AND l2 - high >= coalesce(0.25 * atr, 0))""",
    "fvgm": "SELECT f.*, f.created_i AS source_i, (SELECT min(b.i) FROM bars b WHERE b.symbol = f.symbol AND b.i > f.created_i AND b.low <= f.top AND b.high >= f.bottom) AS mitigated_i FROM fvg f",
    "ifvg": """SELECT symbol, CASE type WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END AS type, top, bottom, k AS created_i, created_i AS source_i FROM (
      SELECT f.*, (SELECT min(b.i) FROM bars b WHERE b.symbol = f.symbol AND b.i > f.created_i AND CASE f.type WHEN 'bullish' THEN b.close < f.bottom ELSE b.close > f.top END) AS k FROM fvg f) WHERE k IS NOT NULL""",
    "ifvgm": "SELECT f.*, (SELECT min(b.i) FROM bars b WHERE b.symbol = f.symbol AND b.i > f.created_i AND b.low <= f.top AND b.high >= f.bottom) AS mitigated_i FROM ifvg f",
    "ob": """SELECT symbol, CASE WHEN bos > 0 THEN 'bullish' ELSE 'bearish' END AS type, b.high AS top, b.low AS bottom, created_i, source_i FROM (
      SELECT m.symbol, m.bos, m.i AS created_i, (SELECT max(b.i) FROM bars b WHERE b.symbol = m.symbol AND b.i BETWEEN m.i - 20 AND m.i - 1 AND CASE WHEN m.bos > 0 THEN b.close < b.open ELSE b.close > b.open END) AS source_i FROM ms m WHERE m.bos <> 0) x
      JOIN bars b USING (symbol) WHERE b.i = x.source_i""",
    "liq": f"""SELECT symbol, i, high, low, close, atr, CASE WHEN len(hs) = 0 THEN NULL WHEN coalesce(atr, 0) <= 0 THEN hs[-1] ELSE list_avg(list_filter(hs, lambda p: abs(p - hs[-1]) <= 0.1 * atr)) END AS bs,
        CASE WHEN len(ls) = 0 THEN NULL WHEN coalesce(atr, 0) <= 0 THEN ls[-1] ELSE list_avg(list_filter(ls, lambda p: abs(p - ls[-1]) <= 0.1 * atr)) END AS ss FROM (
      SELECT s.*, o.atr, coalesce(list(sh) FILTER (sh IS NOT NULL) OVER (PARTITION BY s.symbol ORDER BY s.i ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), []) AS hs,
        coalesce(list(sl) FILTER (sl IS NOT NULL) OVER (PARTITION BY s.symbol ORDER BY s.i ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), []) AS ls FROM swing s JOIN osc o USING (symbol, i))""",
    "sweep": """SELECT *, CASE WHEN bs IS NOT NULL THEN coalesce(atr, 0) <> 0 AND high > bs AND close < bs END AS bsw, CASE WHEN ss IS NOT NULL THEN coalesce(atr, 0) <> 0 AND low < ss AND close > ss END AS ssw FROM liq""",
    "pd": f"""SELECT symbol, i, CASE WHEN i >= 49 AND hi > lo THEN (close - lo) / (hi - lo) END AS pd_position FROM (SELECT *, max(high) OVER {_w("49 PRECEDING", "CURRENT ROW")} AS hi, min(low) OVER {_w("49 PRECEDING", "CURRENT ROW")} AS lo FROM bars)""",
    "zdist": """SELECT o.symbol, o.i, (SELECT min(greatest(0, b.close - z.top, z.bottom - b.close)) FROM fvg z WHERE z.symbol = o.symbol AND z.created_i <= o.i) / o.atr AS dist_to_fvg,
        (SELECT min(greatest(0, b.close - z.top, z.bottom - b.close)) FROM ifvg z WHERE z.symbol = o.symbol AND z.created_i <= o.i) / o.atr AS dist_to_ifvg FROM osc o JOIN bars b USING (symbol, i) WHERE o.atr > 0""",
    "ctx": "SELECT m.symbol, m.i, m.high, m.low, m.close, m.bias, o.atr FROM ms m JOIN osc o USING (symbol, i) WHERE o.atr > 0",
    "hits": """SELECT c.symbol, c.i, z.rank, z.source_i, z.kind, z.type, z.top, z.bottom FROM ctx c JOIN (
        SELECT 1 AS rank, 'ifvg' AS kind, symbol, type, top, bottom, created_i, source_i, mitigated_i FROM ifvgm UNION ALL SELECT 2, 'fvg', symbol, type, top, bottom, created_i, source_i, mitigated_i FROM fvgm
        UNION ALL SELECT 3, 'order_block', symbol, type, top, bottom, created_i, created_i, NULL FROM ob) z
      ON z.symbol = c.symbol AND z.created_i < c.i AND c.i <= coalesce(z.mitigated_i, c.i) AND c.low - 0.15 * c.atr <= z.top AND c.high + 0.15 * c.atr >= z.bottom AND ((z.type = 'bullish' AND c.bias >= 0) OR (z.type = 'bearish' AND c.bias <= 0))""",
    "sigs": """SELECT b.symbol, b.i, b.timestamp, b.open, b.high, b.low, b.close, o.atr, o.rsi, CASE h.type WHEN 'bullish' THEN 'long' WHEN 'bearish' THEN 'short' ELSE 'none' END AS direction, coalesce(h.kind, 'none') AS entry_type,
        CASE WHEN h.kind IS NOT NULL THEN o.atr END AS stop_dist, CASE WHEN h.kind IS NOT NULL THEN 2 * o.atr END AS target_dist, h.top AS zone_top, h.bottom AS zone_bottom
      FROM bars b JOIN osc o USING (symbol, i) LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY rank, source_i) = 1) h USING (symbol, i)""",
    "cand": "SELECT symbol, i, close, atr, CASE direction WHEN 'long' THEN 1 ELSE -1 END AS s FROM sigs JOIN ends USING (symbol) WHERE direction <> 'none' AND atr > 0 AND i + 24 < n",
    "lab": """SELECT c.symbol, c.i, coalesce(arg_min(CASE WHEN stopped THEN -1 ELSE 1 END, x.j), 0) AS label, coalesce(min(x.j) - c.i, 24) AS horizon_used FROM cand c LEFT JOIN (
        SELECT c.symbol, c.i, b.i AS j, CASE WHEN s > 0 THEN b.low <= c.close - c.atr ELSE b.high >= c.close + c.atr END AS stopped, CASE WHEN s > 0 THEN b.high >= c.close + 2 * c.atr ELSE b.low <= c.close - 2 * c.atr END AS reached
        FROM cand c JOIN bars b ON b.symbol = c.symbol AND b.i BETWEEN c.i + 1 AND c.i + 24 WHERE stopped OR reached) x ON x.symbol = c.symbol AND x.i = c.i GROUP BY c.symbol, c.i""",
    "sale": "SELECT symbol, i, b.close, atr FROM osc JOIN bars b USING (symbol, i) JOIN ends USING (symbol) WHERE atr > 0 AND i + 12 < n",
    "sizes": "SELECT symbol, n, least(2000, greatest(50, floor(n * 0.6)))::BIGINT AS tr, least(500, greatest(20, floor(n * 0.2)))::BIGINT AS te FROM ends",
    "blocks": "SELECT symbol, k AS fold, 0::BIGINT AS train_lo, (tr + k * te)::BIGINT AS train_hi, (tr + 24 + k * te)::BIGINT AS test_lo, (tr + 24 + k * te + te)::BIGINT AS test_hi FROM sizes, (SELECT unnest(range(0, 200)) AS k) WHERE tr + 24 + k * te + te <= n",
    "folds": "SELECT symbol, fold, train_lo, train_hi, test_lo, test_hi FROM blocks UNION ALL SELECT symbol, 0, 0, greatest(1, greatest(1, n - te) - 24), greatest(1, n - te), n FROM sizes WHERE symbol NOT IN (SELECT symbol FROM blocks) AND greatest(1, n - te) < n",
    "win": "SELECT symbol, min(test_lo) AS a, max(test_hi) - 1 AS z FROM folds GROUP BY symbol",
    "poss": """SELECT s.symbol, s.i AS e, s.direction, s.close AS entry_price, s.stop_dist, s.entry_type, w.z, s.close - (CASE s.direction WHEN 'long' THEN 1 ELSE -1 END) * s.stop_dist AS stop, s.close + (CASE s.direction WHEN 'long' THEN 1 ELSE -1 END) * s.target_dist AS target
      FROM sigs s JOIN win w USING (symbol) WHERE s.i BETWEEN w.a AND w.z AND s.direction <> 'none' AND s.stop_dist > 0 AND s.rsi / 100 >= 0.5""",
    "exits": """SELECT p.*, x.i AS xi, x.reason, x.price FROM poss p LEFT JOIN (SELECT p.symbol, p.e, b.i,
        CASE WHEN CASE direction WHEN 'long' THEN b.low <= stop ELSE b.high >= stop END THEN 'stop' WHEN CASE direction WHEN 'long' THEN b.high >= target ELSE b.low <= target END THEN 'target' WHEN b.i - p.e >= 24 THEN 'time' END AS reason,
        CASE WHEN CASE direction WHEN 'long' THEN b.low <= stop ELSE b.high >= stop END THEN stop WHEN CASE direction WHEN 'long' THEN b.high >= target ELSE b.low <= target END THEN target ELSE b.close END AS price
        FROM poss p JOIN bars b ON b.symbol = p.symbol AND b.i BETWEEN p.e + 1 AND least(p.e + 24, p.z) WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.symbol, p.e ORDER BY b.i) = 1) x ON x.symbol = p.symbol AND x.e = p.e""",
    "queue": """SELECT x.symbol, x.e, x.direction, x.entry_price, x.stop_dist, x.entry_type, x.xi IS NULL AS forced, coalesce(x.xi, x.z) AS exit_i, coalesce(x.reason, 'time') AS exit_reason, coalesce(x.price, b.close) AS exit_price,
        (CASE x.direction WHEN 'long' THEN 1 ELSE -1 END) * (coalesce(x.price, b.close) - x.entry_price) AS move FROM exits x JOIN bars b ON b.symbol = x.symbol AND b.i = x.z""",
    "taken": """SELECT symbol, -1::BIGINT AS e, 0::BIGINT AS free, 10000::DOUBLE AS equity, 0::DOUBLE AS lots, 0::DOUBLE AS gross, 0::DOUBLE AS net FROM ends
      UNION ALL (SELECT q.symbol, q.e, CASE WHEN q.forced THEN 9000000000000000000 ELSE q.exit_i END,
        t.equity + (q.move * 100 - 0.2 * 100 - 6) * least(0.01 * t.equity / (q.stop_dist * 100), 1), least(0.01 * t.equity / (q.stop_dist * 100), 1), q.move * 100 * least(0.01 * t.equity / (q.stop_dist * 100), 1), (q.move * 100 - 0.2 * 100 - 6) * least(0.01 * t.equity / (q.stop_dist * 100), 1)
      FROM taken t JOIN queue q ON q.symbol = t.symbol AND q.e >= t.free AND q.e > t.e WHERE t.equity > 0 AND q.e = (SELECT min(y.e) FROM queue y WHERE y.symbol = t.symbol AND y.e >= t.free AND y.e > t.e))""",
    "free": "SELECT q.*, t.lots, t.gross, t.net FROM taken t JOIN queue q ON q.symbol = t.symbol AND q.e = t.e",
    "mark0": """SELECT b.symbol, b.i, b.timestamp, 10000 + coalesce((SELECT sum(f.net) FROM free f WHERE f.symbol = b.symbol AND NOT f.forced AND f.exit_i <= b.i), 0) + coalesce((SELECT sum(((CASE f.direction WHEN 'long' THEN 1 ELSE -1 END) * (b.close - f.entry_price) * 100 - 26) * f.lots)
        FROM free f WHERE f.symbol = b.symbol AND f.e < b.i AND (b.i < f.exit_i OR f.forced)), 0) AS eq FROM bars b JOIN win w USING (symbol) WHERE b.i BETWEEN w.a AND w.z""",
    "stopped": f"SELECT symbol, min(i) AS br FROM (SELECT *, greatest(10000, max(eq) OVER {NOW}) AS peak FROM mark0) WHERE (peak - eq) / peak >= 0.2 GROUP BY symbol",
    "trades": "SELECT f.* FROM free f LEFT JOIN stopped s USING (symbol) WHERE s.br IS NULL OR f.e < s.br",
    "curve": """SELECT b.symbol, b.i, b.timestamp, w.z, EXISTS (SELECT 1 FROM trades f WHERE f.symbol = b.symbol AND f.e < b.i AND (b.i < f.exit_i OR f.forced)) AS in_market,
        CASE WHEN b.i = w.z AND EXISTS (SELECT 1 FROM trades f WHERE f.symbol = b.symbol AND f.forced) THEN 10000 + (SELECT sum(f.net) FROM trades f WHERE f.symbol = b.symbol)
        ELSE 10000 + coalesce((SELECT sum(f.net) FROM trades f WHERE f.symbol = b.symbol AND NOT f.forced AND f.exit_i <= b.i), 0) + coalesce((SELECT sum(((CASE f.direction WHEN 'long' THEN 1 ELSE -1 END) * (b.close - f.entry_price) * 100 - 26) * f.lots)
        FROM trades f WHERE f.symbol = b.symbol AND f.e < b.i AND (b.i < f.exit_i OR f.forced)), 0) END AS equity FROM bars b JOIN win w USING (symbol) WHERE b.i BETWEEN w.a AND w.z""",
    "dd": f"""SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS dd, last_value(CASE WHEN was IS NULL OR equity > was THEN i END IGNORE NULLS) OVER {NOW} AS peak_i
      FROM (SELECT *, max(equity) OVER {NOW} AS peak, max(equity) OVER {PAST} AS was, {_div(f"equity - lag(equity) OVER {W}", f"lag(equity) OVER {W}")} AS ret FROM curve)""",
    "feat": f"""SELECT b.symbol, b.i, b.close, ret_1, logret_1, ret_5, logret_5, ret_10, logret_10, volatility, {", ".join(f"{_div(f'b.close - e{s}', f'e{s}')} AS ema_{s}_dist" for s in (9, 21, 50, 200))}, o.rsi, macd, macd_signal, macd_hist, o.atr, pctb AS bb_pctb, bandwidth AS bb_bandwidth, chan.pos AS channel_pos,
        body_ratio, upper_wick_ratio, lower_wick_ratio, candle_range, {", ".join(f"{n}::INTEGER::DOUBLE AS {n}" for n in ("is_doji", "is_hammer", "is_shooting_star", "is_bullish_engulfing", "is_bearish_engulfing"))},
        bias::DOUBLE AS ms_bias, bos::DOUBLE AS ms_bos, choch::DOUBLE AS ms_choch, since_bos::DOUBLE AS bars_since_bos, since_choch::DOUBLE AS bars_since_choch, in_killzone::INTEGER::DOUBLE AS in_killzone, pd_position, (pd_position > 0.5)::INTEGER::DOUBLE AS premium,
        bsw::INTEGER::DOUBLE AS buyside_sweep, ssw::INTEGER::DOUBLE AS sellside_sweep, CASE WHEN o.atr > 0 THEN (b.close - bs) / o.atr END AS dist_to_buyside, CASE WHEN o.atr > 0 THEN (b.close - ss) / o.atr END AS dist_to_sellside, dist_to_fvg, dist_to_ifvg,
        (entry_type = 'ifvg')::INTEGER::DOUBLE AS is_in_ifvg_retest, CASE sigs.direction WHEN 'long' THEN 1.0::DOUBLE WHEN 'short' THEN -1.0 ELSE 0.0 END AS signal_dir, (entry_type = 'ifvg')::INTEGER::DOUBLE AS entry_is_primary
      FROM bars b JOIN ret USING (symbol, i) JOIN vol USING (symbol, i) JOIN osc o USING (symbol, i) JOIN boll USING (symbol, i) JOIN chan USING (symbol, i) JOIN pat USING (symbol, i) JOIN ms USING (symbol, i) JOIN kz USING (symbol, i) JOIN pd USING (symbol, i)
        JOIN sweep USING (symbol, i) JOIN sigs USING (symbol, i) LEFT JOIN zdist USING (symbol, i)""",
    "lags": f"""SELECT *, {", ".join(f"lag({s}, {k}) OVER {W} AS {s}_lag{k}" for s in ("ret_1", "rsi", "macd_hist", "ms_bias", "atr") for k in (1, 5, 10))} FROM feat""",
}


def sql(select: str) -> str:
    """The statement with the common table expressions that it needs, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                add(CTE[name])

    add(select)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" if n not in ("rec", "taken") else f"{n} AS ({CTE[n]})" for n in CTE if n in need)
    return f"WITH RECURSIVE {parts}\n{select}" if parts else select
