"""SQL text shared by the twins: the market views and the indicator and feature chains.

Written independently of the DataFrame code: recurrences are recursive CTEs over row
numbers, frames are window clauses. Only what a twin selects is computed.
"""

from __future__ import annotations

S = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

BARS = f"""bars AS MATERIALIZED (
SELECT symbol, ts, min_by(price, k) AS open, max(price) AS high, min(price) AS low,
       max_by(price, k) AS close, CAST(sum(qty) AS DOUBLE) AS volume
FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price,
             l_quantity AS qty, {S} AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol, ts)"""

CONTRACTS = """contracts AS MATERIALIZED (
SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
       CASE WHEN day(l_shipdate) <= 14 THEN CAST(date_trunc('month', l_shipdate) AS DATE) + 14 ELSE last_day(CAST(l_shipdate AS DATE)) END AS expiry_date, CAST(p_size * 200 AS DOUBLE) AS strike,
       CASE WHEN l_linestatus = 'F' THEN 'CE' ELSE 'PE' END AS option_type,
       CAST(sum(l_quantity) AS BIGINT) AS open_int,
       floor(avg(l_extendedprice * l_discount / l_quantity) * 100 + 0.5001) / 100 AS settle_price, count(*) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5)"""

VIX = """vix AS MATERIALIZED (
SELECT CAST(l_shipdate AS DATE) AS ts,
       round(greatest(CAST(8 AS DOUBLE), 15 + 600 * (avg(l_discount) - CAST(0.05 AS DOUBLE))), 4) AS vix
FROM lineitem GROUP BY 1)"""

TICKS = """ticks AS (
SELECT event_type AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS volume, event_id FROM events)"""

ARTICLES = """articles AS (
SELECT doc_id, source, lang, source AS title, text AS summary,
       CAST('2024-01-31 00:00:00' AS TIMESTAMP) - doc_id * INTERVAL '1' HOUR AS published
FROM documents)"""

FILLS = """fills AS (
SELECT o_orderkey AS fill_id, o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS ts,
       o_totalprice AS trade_value, CAST(50 + o_orderkey % 50 AS DOUBLE) AS ml_confidence,
       CAST(50 + o_orderkey * 7 % 50 AS DOUBLE) AS tech_score,
       o_totalprice * CAST(o_orderkey % 11 - 5 AS DOUBLE) / 128 AS pnl
FROM orders)"""

W = "PARTITION BY symbol ORDER BY ts"


def frame(agg: str, a: int, b: int) -> str:
    """Aggregate over rows a..b relative to the current one."""
    def edge(n):
        return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"{agg} OVER ({W} ROWS BETWEEN {edge(a)} AND {edge(b)})"


def roll(fn: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    a, b = -(n - 1) - shift, -shift
    return f"CASE WHEN {frame(f'count({x})', a, b)} >= {least or n} THEN {frame(f'{fn}({x})', a, b)} END"


def quant(x: str, q: float, n: int, least: int | None = None) -> str:
    return f"CASE WHEN {frame(f'count({x})', 1 - n, 0)} >= {least or n} THEN {frame(f'quantile_cont({x}, {q})', 1 - n, 0)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({W})"


def past(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, CAST({lo} AS DOUBLE)), CAST({hi} AS DOUBLE)) END"


def fill(x: str, d) -> str:
    return f"coalesce({x}, CAST({d} AS DOUBLE))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INTEGER)"


def ratio(a: str, b: str) -> str:
    return clip(fill(f"{div(a, b)} - 1", 0), -0.5, 0.5)


def ema(alpha: str):
    def spec(x):
        return (f"s.{x}", f"CASE WHEN r.{{o}} IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN r.{{o}} "
                          f"ELSE s.{x} * ({alpha}) + r.{{o}} * (1 - ({alpha})) END")
    return spec


def wilder(n: int, seed: str, at: int):
    def spec(x):
        return ("CAST(NULL AS DOUBLE)", f"CASE WHEN s.rn < {at} THEN NULL WHEN s.rn = {at} THEN s.{seed} "
                                        f"ELSE (r.{{o}} * {n - 1} + s.{x}) / {n} END")
    return spec


def recursion(name: str, src: str, specs: dict) -> str:
    """A recursive CTE with one column per recurrence: out -> (input column, spec)."""
    pairs = {o: spec(x) for o, (x, spec) in specs.items()}
    first = ", ".join(f"CAST({i} AS DOUBLE) AS {o}" for o, (i, _) in pairs.items())
    step = ", ".join(st.format(o=o) for o, (_, st) in pairs.items())
    return (f"{name} AS (SELECT s.symbol, s.rn, {first} FROM {src} s WHERE s.rn = 1 UNION ALL "
            f"SELECT s.symbol, s.rn, {step} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)")


def mid(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


A2 = {n: f"CAST(2 AS DOUBLE) / {n + 1}" for n in (5, 9, 12, 20, 21, 26)}
W14 = "CAST(1 AS DOUBLE) / 14"

IND = ",\n".join([
    f"""i0 AS (SELECT *, row_number() OVER ({W}) AS rn, (high + low + close) / 3 AS tp, {lag('close')} AS pc, {lag('high')} AS ph,
 {lag('low')} AS pl, {roll('avg', 'close', 200)} AS sma200, {roll('avg', 'close', 20)} AS bb_mid, {roll('stddev_pop', 'close', 20)} AS bsd,
 {roll('max', 'high', 14)} AS wh, {roll('min', 'low', 14)} AS wl, {roll('avg', 'volume', 20)} AS vm, {roll('max', 'high', 252)} AS fib_high,
 {roll('min', 'low', 252)} AS fib_low, {mid(9)} AS ichimoku_tenkan, {mid(26)} AS ichimoku_kijun, {mid(52)} AS m52 FROM bars)""",
    f"""i1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
 CASE WHEN close - pc > 0 THEN close - pc ELSE 0 END AS gain, CASE WHEN close - pc < 0 THEN pc - close ELSE 0 END AS loss,
 CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
 CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS ndm,
 CASE WHEN close < pc THEN -volume ELSE volume END AS sv,
 coalesce({div(roll('sum', 'tp * volume', 20, 5), roll('sum', 'volume', 20, 5))}, close) AS vwap,
 {roll('avg', 'tp', 20)} AS tpm,
 bb_mid + 2 * bsd AS bb_upper, bb_mid - 2 * bsd AS bb_lower, {div('4 * bsd', 'bb_mid')} AS bb_width,
 {div('close - bb_mid + 2 * bsd', '4 * bsd')} AS bb_pct, {div('(wh - close) * -100', 'wh - wl')} AS williams_r,
 {div('volume', 'vm')} AS vol_ratio, fib_high - fib_low AS fib_range, (ph + pl + pc) / 3 AS pivot_point FROM i0)""",
    """md AS (SELECT a.symbol, a.rn, sum(abs(b.tp - a.tpm)) / 20 AS md FROM i1 a CROSS JOIN range(20) o(k)
 JOIN i1 b ON b.symbol = a.symbol AND b.rn = a.rn - o.k WHERE a.rn >= 20 GROUP BY 1, 2)""",
    f"""i2 AS MATERIALIZED (SELECT *, {roll('avg', 'tr', 14)} AS s14, {roll('avg', 'tr', 10)} AS s10, {roll('avg', 'pdm', 14)} AS spd,
 {roll('avg', 'ndm', 14)} AS snd, CAST(sum(sv) OVER ({W} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv, {quant('bb_width', 0.2, 50)} AS bq,
 {lag('(ichimoku_tenkan + ichimoku_kijun) / 2', 26)} AS ichimoku_span_a, {lag('m52', 26)} AS ichimoku_span_b,
 {lag('ichimoku_tenkan')} AS tk, {lag('ichimoku_kijun')} AS kj, (tp - tpm) / nullif(0.015 * md, 0) AS cci FROM i1 LEFT JOIN md USING (symbol, rn))""",
    recursion("r1", "i2", {
        "e9": ("close", ema(A2[9])), "e21": ("close", ema(A2[21])), "e12": ("close", ema(A2[12])), "e26": ("close", ema(A2[26])),
        "g": ("gain", ema(W14)), "d": ("loss", ema(W14)), "w14": ("tr", wilder(14, "s14", 14)), "w10": ("tr", wilder(10, "s10", 10)),
        "wtr": ("tr", wilder(14, "s14", 15)), "wpd": ("pdm", wilder(14, "spd", 15)), "wnd": ("ndm", wilder(14, "snd", 15)),
        "oe": ("obv", ema(A2[20]))}),
    f"""i3 AS (SELECT i2.*, CASE WHEN i2.rn >= 9 THEN e9 END AS ema_fast, CASE WHEN i2.rn >= 21 THEN e21 END AS ema_slow,
 CASE WHEN i2.rn >= 26 THEN e12 - e26 END AS macd, CASE WHEN i2.rn < 14 THEN NULL WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + g / d) END AS rsi,
 coalesce(w14, 0) AS atr, coalesce(w10, 0) AS atr10, coalesce({div('wpd * 100', 'wtr')}, 0) AS adx_pos,
 coalesce({div('wnd * 100', 'wtr')}, 0) AS adx_neg, coalesce({div('abs(wpd - wnd) * 100', 'wpd + wnd')}, 0) AS dx,
 CASE WHEN i2.rn >= 20 THEN oe END AS obv_ema FROM i2 JOIN r1 ON i2.symbol = r1.symbol AND i2.rn = r1.rn)""",
    f"""i4 AS MATERIALIZED (SELECT *, {roll('avg', 'dx', 14)} AS sdx, {lag('close', 5)} AS c5, {lag('rsi', 5)} AS r5, {roll('min', 'rsi', 14)} AS rl,
 {roll('max', 'rsi', 14)} AS rh, {lag('(high + low) / 2 + 3 * atr10')} AS st_up, {lag('(high + low) / 2 - 3 * atr10')} AS st_dn FROM i3)""",
    recursion("r2", "i4", {"sig": ("macd", ema(A2[9])), "wadx": ("dx", wilder(14, "sdx", 28))}),
    f"""i5 AS (SELECT i4.*, CASE WHEN i4.rn >= 34 THEN sig END AS macd_signal, coalesce(wadx, 0) AS adx, {flag('ema_fast > ema_slow')} AS ema_cross,
 {div('rsi - rl', 'rh - rl')} AS st, CASE WHEN close > st_up THEN 1 WHEN close < st_dn THEN -1 END AS ev,
 close - 1.5 * atr AS stop_loss, close + 3 * atr AS take_profit FROM i4 JOIN r2 ON i4.symbol = r2.symbol AND i4.rn = r2.rn)""",
    f"""i6 AS (SELECT *, macd - macd_signal AS macd_hist, {lag('ema_cross')} AS ema_cross_prev, {lag('macd')} AS lm, {lag('macd_signal')} AS lg,
 {roll('avg', 'st', 3)} * 100 AS stochrsi_k, {past('ev')} AS dir FROM i5)""",
    f"""ind AS MATERIALIZED (SELECT *, {flag('close > sma200')} AS above_sma200, {flag('close > vwap')} AS above_vwap,
 {flag('close <= bb_lower')} AS bb_touch_lower, {flag('close >= bb_upper')} AS bb_touch_upper, {flag('bb_width < bq')} AS bb_squeeze,
 {flag('williams_r < -80')} AS williams_oversold, {flag('williams_r > -20')} AS williams_overbought,
 {flag('cci < -100')} AS cci_oversold, {flag('cci > 100')} AS cci_overbought, {flag('vol_ratio > 1.5')} AS vol_spike,
 2 * pivot_point - pl AS pivot_r1, 2 * pivot_point - ph AS pivot_s1, pivot_point + (ph - pl) AS pivot_r2, pivot_point - (ph - pl) AS pivot_s2,
 {flag('abs(close - (2 * pivot_point - ph)) / close < 0.015')} AS near_support,
 {flag('close > greatest(ichimoku_span_a, ichimoku_span_b)')} AS above_cloud, {flag('close < least(ichimoku_span_a, ichimoku_span_b)')} AS below_cloud,
 {flag('ichimoku_tenkan > ichimoku_kijun AND tk <= kj')} AS tk_cross_bull, {flag('obv > obv_ema')} AS obv_rising,
 {flag('ema_cross = 1 AND ema_cross_prev = 0')} AS ema_golden, {flag('ema_cross = 0 AND ema_cross_prev = 1')} AS ema_death,
 {flag('rsi < 30')} AS rsi_oversold, {flag('rsi > 70')} AS rsi_overbought, {flag('close < c5 AND rsi > r5')} AS rsi_bull_div,
 {flag('macd > macd_signal AND lm <= lg')} AS macd_bullish, {flag('macd < macd_signal AND lm >= lg')} AS macd_bearish,
 {roll('avg', 'stochrsi_k', 3)} AS stochrsi_d, {flag('stochrsi_k < 20')} AS stochrsi_oversold, {flag('adx > 25')} AS trending,
 {flag('dir = 1')} AS supertrend_bull, abs(close - (fib_high - 0.236 * fib_range)) / close AS d1, abs(close - (fib_high - 0.382 * fib_range)) / close AS d2,
 abs(close - (fib_high - 0.618 * fib_range)) / close AS d3, abs(close - (fib_high - 0.786 * fib_range)) / close AS d4 FROM i6)""",
])

FIB_SCORE = ("CASE WHEN d4 < 0.015 THEN 1 - d4 / 0.015 WHEN d3 < 0.015 THEN 1 - d3 / 0.015 "
             "WHEN d2 < 0.015 THEN 1 - d2 / 0.015 WHEN d1 < 0.015 THEN 1 - d1 / 0.015 ELSE 0 END")
FIB_LEVEL = ("CASE WHEN d4 < 0.015 THEN 0.786 WHEN d3 < 0.015 THEN 0.618 WHEN d2 < 0.015 THEN 0.382 "
             "WHEN d1 < 0.015 THEN 0.236 END")


def rnd(cols: list[str], digits: int = 4) -> str:
    """Select list with doubles rounded; a name alone or 'expression AS name'."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        expr, name = (expr or c), (name if expr else c)
        out.append(f"{near(expr, digits)} AS {name}")
    return ", ".join(out)


def near(expr: str, digits: int = 4) -> str:
    """Rounding for comparison, from just below the half; see the registry's `near`."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + CAST(0.5001 AS DOUBLE)) / 1e{digits}"


def ints(cols: list[str]) -> str:
    return ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in cols)


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def indicator_sql(doubles: list[str], flags: list[str]) -> str:
    cols = ", ".join(x for x in (rnd(doubles), ints(flags)) if x)
    return with_(BARS, IND) + f"SELECT symbol, ts, {cols} FROM ind"


SCORE = f"""sc AS (SELECT *, {FIB_SCORE} AS fib_score, coalesce(rsi, 50) AS q_rsi, coalesce(macd_hist, 0) AS q_hist,
 coalesce(bb_pct, 0.5) AS q_pct, coalesce(vol_ratio, 1) AS q_vol FROM ind),
sc1 AS (SELECT *,
 CASE WHEN q_rsi < 30 THEN 1 WHEN q_rsi < 45 THEN 0.6 WHEN q_rsi > 70 THEN -1 ELSE greatest(CAST(0 AS DOUBLE), (50 - q_rsi) / 50) END AS p_rsi,
 CASE WHEN macd_bullish = 1 THEN 1 WHEN q_hist > 0 THEN 0.5 WHEN macd_bearish = 1 THEN -1 ELSE 0 END AS p_macd,
 CASE WHEN bb_touch_lower = 1 THEN 1 WHEN q_pct < 0.2 THEN 0.6 WHEN bb_touch_upper = 1 THEN -1 WHEN bb_squeeze = 1 THEN 0.3 ELSE 0 END AS p_bb,
 CASE WHEN vol_spike = 1 THEN 0.8 WHEN q_vol > 1.2 THEN 0.4 ELSE 0 END AS p_vol,
 CASE WHEN ema_golden = 1 THEN 1 WHEN ema_cross = 1 THEN 0.5 WHEN ema_death = 1 THEN -1 ELSE 0 END AS p_ema,
 CAST(q_rsi < 30 AS INTEGER) + macd_bullish + bb_touch_lower + vol_spike + CAST(fib_score > 0.5 AS INTEGER) + ema_golden AS confirmations,
 CAST(q_rsi > 70 AS INTEGER) + CASE WHEN macd_bullish = 0 AND q_hist <= 0 THEN macd_bearish ELSE 0 END
 + CASE WHEN bb_touch_lower = 0 AND q_pct >= 0.2 THEN bb_touch_upper ELSE 0 END
 + CASE WHEN ema_golden = 0 AND ema_cross = 0 THEN ema_death ELSE 0 END AS bear_confirmations FROM sc),
sc2 AS (SELECT *, least(greatest((CAST(p_rsi AS DOUBLE) * 0.25 + CAST(p_macd AS DOUBLE) * 0.20 + CAST(p_bb AS DOUBLE) * 0.15 + CAST(p_vol AS DOUBLE) * 0.15
 + fib_score * 0.10 + CAST(p_ema AS DOUBLE) * 0.15 + 1) / 2 * 100, 0), 100) AS score FROM sc1),
scored AS MATERIALIZED (SELECT * EXCLUDE (stop_loss, take_profit), round(score, 1) AS tech_score,
 CASE WHEN confirmations >= 3 AND score >= 75 THEN 'STRONG BUY' WHEN score >= 60 THEN 'BUY'
      WHEN bear_confirmations >= 3 AND score <= 25 THEN 'STRONG SELL' WHEN score <= 40 THEN 'SELL' ELSE 'HOLD' END AS signal,
 round(coalesce(stop_loss, close * 0.97), 2) AS stop_loss, round(coalesce(take_profit, close * 1.05), 2) AS take_profit FROM sc2)"""

OPTIONS = """near AS (SELECT c.* FROM contracts c JOIN (SELECT trade_date, symbol, min(expiry_date) AS e FROM contracts GROUP BY 1, 2) m
 ON c.trade_date = m.trade_date AND c.symbol = m.symbol AND c.expiry_date = m.e),
strikes AS MATERIALIZED (SELECT trade_date, symbol, expiry_date, strike, CAST(sum(CASE WHEN option_type = 'CE' THEN open_int ELSE 0 END) AS BIGINT) AS call_oi,
 CAST(sum(CASE WHEN option_type = 'PE' THEN open_int ELSE 0 END) AS BIGINT) AS put_oi, max(CASE WHEN option_type = 'CE' THEN settle_price END) AS call_settle
 FROM near GROUP BY 1, 2, 3, 4),
pcr AS (SELECT trade_date, symbol, CAST(sum(call_oi) AS BIGINT) AS call_oi, CAST(sum(put_oi) AS BIGINT) AS put_oi,
 round(sum(put_oi) / greatest(1, sum(call_oi)), 4) AS pcr FROM strikes GROUP BY 1, 2),
atm AS (SELECT trade_date, symbol, strike AS atm_strike, expiry_date, call_settle AS atm_settle FROM strikes
 QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY call_oi + put_oi DESC, strike) = 1),
iv AS (SELECT trade_date, symbol, CASE WHEN atm_strike > 0 AND atm_settle > 0 THEN least(greatest(
 atm_settle / atm_strike / sqrt(CAST(greatest(1, date_diff('day', trade_date, expiry_date)) AS DOUBLE) / 365) * 100, 3), 120) ELSE 0 END AS atm_iv FROM atm),
pains AS (SELECT a.trade_date, a.symbol, a.strike AS x, sum(greatest(0, a.strike - b.strike) * b.call_oi + greatest(0, b.strike - a.strike) * b.put_oi) AS pain
 FROM strikes a JOIN strikes b ON a.trade_date = b.trade_date AND a.symbol = b.symbol GROUP BY 1, 2, 3),
mp AS (SELECT trade_date, symbol, x AS max_pain, pain FROM pains
 QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY pain, x) = 1),
summary AS MATERIALIZED (SELECT trade_date, symbol, pcr, atm_iv, max_pain, call_oi, put_oi FROM pcr JOIN iv USING (trade_date, symbol) JOIN mp USING (trade_date, symbol)),
ivr AS (SELECT *, CASE WHEN hi > lo THEN (atm_iv - lo) * 100 / (hi - lo) ELSE 50 END AS iv_rank FROM (SELECT *,
 min(atm_iv) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 252 PRECEDING) AS lo, max(atm_iv) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 252 PRECEDING) AS hi
 FROM summary WHERE atm_iv > 0))"""


def fir(x: str, weights) -> str:
    return " + ".join(f"({x if i == 0 else lag(x, i)}) * CAST({w!r} AS DOUBLE)" for i, w in enumerate(weights))


# Weights of the edge smoothers, newest first, written out as an independent check of the rule
# that derives them (least squares at the newest point).
EDGE_7_2 = [32 / 42, 15 / 42, 3 / 42, -4 / 42, -6 / 42, -3 / 42, 5 / 42]


def line_weights(window: int, degree: int, deriv: int) -> list[float]:
    """Edge weights from the normal equations solved in exact fractions."""
    from fractions import Fraction

    xs = [Fraction(-i) for i in range(window)]
    m = degree + 1
    a = [[sum((x ** (i + j) for x in xs), Fraction(0)) for j in range(m)] + [Fraction(int(i == deriv))] for i in range(m)]
    for i in range(m):
        p = next(r for r in range(i, m) if a[r][i] != 0)
        a[i], a[p] = a[p], a[i]
        a[i] = [v / a[i][i] for v in a[i]]
        for r in range(m):
            if r != i:
                a[r] = [v - a[r][i] * w for v, w in zip(a[r], a[i])]
    scale = 2 if deriv == 2 else 1
    return [float(scale * sum(a[j][m] * x ** j for j in range(m))) for x in xs]


def pct_rank(x: str, xs: str, least: int) -> str:
    """Average-tie rank share of x among the list xs of its frame."""
    return (f"CASE WHEN len({xs}) >= {least} AND {x} IS NOT NULL THEN (len(list_filter({xs}, lambda e: e < {x})) "
            f"+ CAST(len(list_filter({xs}, lambda e: e = {x})) + 1 AS DOUBLE) / 2) / len({xs}) END")


def change(a: str, b: str) -> str:
    return f"({div(a, b)} - 1)"


SPAN = "nullif(high - low, 0)"
CN = "CAST(3 AS DOUBLE)"

# Market values of each bar: neutral, or the latest known at its date.
NEUTRAL = """fm AS (SELECT ind.*, CAST(15 AS DOUBLE) AS vix, CAST(1 AS DOUBLE) AS pcr, CAST(50 AS DOUBLE) AS iv_rank_level, CAST(NULL AS DOUBLE) AS max_pain, CAST(50 AS DOUBLE) AS sentiment FROM ind)"""
MARKET = """lead1 AS (SELECT trade_date AS ts, pcr, max_pain, iv_rank FROM summary LEFT JOIN (SELECT trade_date AS td, symbol AS sy, iv_rank FROM ivr) ON td = trade_date AND sy = symbol WHERE symbol = 'Brand#1'),
level AS (SELECT DATE '2001-11-04' - CAST(doc_id AS INTEGER) AS ts, avg(CAST(n_chars % 101 AS DOUBLE)) AS sentiment FROM documents GROUP BY 1),
days0 AS (SELECT ts FROM bars UNION SELECT ts FROM vix UNION SELECT ts FROM lead1 UNION SELECT ts FROM level),
mkt AS MATERIALIZED (SELECT ts, last_value(v.vix IGNORE NULLS) OVER o AS vix, last_value(s.pcr IGNORE NULLS) OVER o AS pcr, last_value(s.max_pain IGNORE NULLS) OVER o AS max_pain,
 last_value(s.iv_rank IGNORE NULLS) OVER o AS iv_rank, last_value(l.sentiment IGNORE NULLS) OVER o AS sentiment FROM days0 LEFT JOIN vix v USING (ts) LEFT JOIN lead1 s USING (ts) LEFT JOIN level l USING (ts) WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
fm AS (SELECT ind.*, coalesce(mkt.vix, 15) AS vix, coalesce(mkt.pcr, 1) AS pcr, coalesce(mkt.iv_rank, 50) AS iv_rank_level, mkt.max_pain, coalesce(mkt.sentiment, 50) AS sentiment FROM ind JOIN mkt USING (ts))"""

FEATURE = ",\n".join([
    f"""f0 AS (SELECT *, {lag('close', 1)} AS c1, {lag('close', 3)} AS c3, {lag('close', 10)} AS c10, {lag('close', 20)} AS c20,
 {roll('max', 'close', 252, 50)} AS h252, {roll('min', 'close', 252, 50)} AS l252, nullif(volume, 0) AS zv, close * nullif(volume, 0) AS tv,
 ({fir('close', [5 / 15, 4 / 15, 3 / 15, 2 / 15, 1 / 15])}) * 2 - ({fir('close', [i / 45 for i in range(9, 0, -1)])}) AS hull,
 coalesce({fir('close', EDGE_7_2)}, close) AS sm7, coalesce({fir('close', line_weights(13, 3, 0))}, close) AS sm13,
 coalesce({fir('close', line_weights(15, 4, 2))}, 0) AS acc15, {roll('avg', 'close', 20, 5)} AS m20,
 pow(ln(greatest(abs(nullif({div('high', 'low')}, 0)), CAST(1e-6 AS DOUBLE))), 2) AS hl2,
 ln(greatest(close, CAST(1e-6 AS DOUBLE))) - ln(greatest({lag('close')}, CAST(1e-6 AS DOUBLE))) AS lr,
 {roll('min', 'low', 20, 10, 1)} AS lo20, {roll('max', 'high', 20, 10, 1)} AS hi20, coalesce((close - pc) * volume, 0) AS force,
 {div(roll('sum', 'close * volume', 12, 4), roll('sum', 'volume', 12, 4))} AS vw12, {div(roll('sum', 'close * volume', 26, 8), roll('sum', 'volume', 26, 8))} AS vw26,
 {lag('macd_hist')} AS mh1, {lag('rsi', 5)} AS rsi5, {roll('avg', 'pcr', 5)} AS pcr5, coalesce({roll('avg', 'sentiment', 5)}, 50) AS sent5, {lag('vix', 5)} AS vix5,
 {roll('avg', 'close', 60, 10)} AS zm, {roll('stddev_samp', 'close', 60, 10)} AS zs FROM fm)""",
    f"""f1 AS MATERIALIZED (SELECT *, {change('close', 'c1')} AS ret, abs(close - pc) AS ad, {clip(fill(div('open - pc', 'pc'), 0), -0.1, 0.1)} AS gap_pct,
 coalesce({div('close', 'm20')}, 1) AS cn, {div('close - low - (high - close)', 'high - low')} * zv AS mfv, lr + {lag('lr')} AS lr2,
 {lag('hull')} AS hull1, {lag('sm7', 5)} AS sm7l, {lag('sm13', 10)} AS sm13l, coalesce({past('vw12')}, close) - coalesce({past('vw26')}, close) AS vwl,
 (close - coalesce(zm, 0)) / CASE WHEN zs = 0 THEN 1 ELSE coalesce(zs, 1) END AS zscore FROM f0)""",
    recursion("r3", "f1", {"fe": ("force", ema(A2[5])), "vws": ("vwl", ema(A2[9]))}),
    f"""f2 AS (SELECT f1.*, fe, vws, {frame('list(tv) FILTER (tv IS NOT NULL)', -251, 0)} AS tvs, {frame('list(vix)', -251, 0)} AS vixs, coalesce({frame('stddev_samp(ret)', -4, 0)}, 0) AS sd5, coalesce(abs(ret), 0) / tv AS am,
 {fill(roll('stddev_samp', 'ret', 5), 0.015)} AS realized_vol_5d, {fill(roll('stddev_samp', 'ret', 20), 0.015)} AS realized_vol_20d,
 {clip(fill(div('zv', roll('avg', 'zv', 20, 5)), 1), 0, 10)} AS f_vol_ratio, {frame('regr_slope(cn, rn)', -19, 0)} AS slope,
 CASE WHEN {frame('var_pop(cn)', -19, 0)} > 0 THEN {frame('regr_r2(cn, rn)', -19, 0)} END AS r2,
 {frame('var_pop(lr)', -38, 0)} AS hv1, {frame('var_pop(lr2)', -37, 0)} AS hv2,
 {fill(f"sqrt({roll('avg', 'hl2', 10, 3)} / (4 * ln(2)))", 0.015)} AS parkinson_vol_10d
 FROM f1 JOIN r3 USING (symbol, rn))""",
    f"""fea AS (SELECT symbol, ts, rn, zscore, {', '.join(f"{ratio('close', k)} AS close_to_{k}" for k in ('ema_fast', 'ema_slow', 'sma200', 'bb_upper', 'bb_lower', 'vwap'))},
 {ratio('close', 'h252')} AS close_to_52w_high, {ratio('close', 'l252')} AS close_to_52w_low, {clip(fill(div(SPAN, 'close'), 0.02), 0, 0.15)} AS high_low_range,
 {clip(fill('rsi / 100', 0.5), 0, 1)} AS rsi, CAST({flag('close < c5')} * {flag('rsi > rsi5')} - (1 - {flag('close < c5')}) * (1 - {flag('rsi > rsi5')}) AS DOUBLE) AS rsi_divergence,
 macd_hist, {fill('macd_hist - mh1', 0)} AS macd_hist_accel, {clip('stochrsi_k / 100', 0, 1)} AS stochrsi_k, {clip('williams_r / -100', 0, 1)} AS williams_r,
 {clip('cci / 200', -1, 1)} AS cci, {clip(fill(change('close', 'c5'), 0), -0.3, 0.3)} AS roc_5d, {clip(fill(change('close', 'c20'), 0), -0.5, 0.5)} AS roc_20d,
 CAST(ema_cross AS DOUBLE) AS ema_cross, CAST(above_sma200 AS DOUBLE) AS above_sma200, CAST(above_vwap AS DOUBLE) AS above_vwap, {clip('adx / 50', 0, 1)} AS adx,
 CAST(supertrend_bull AS DOUBLE) AS supertrend_bull, CAST(above_cloud AS DOUBLE) AS above_cloud, {fill('sign(hull - hull1)', 0)} AS hma_slope,
 bb_width, bb_pct, CAST(bb_squeeze AS DOUBLE) AS bb_squeeze, {clip('coalesce(nullif(atr, 0), close * 0.015) / close', 0, 0.1)} AS atr_ratio,
 {clip(fill(div(change('close', 'c5'), 'coalesce(nullif(atr, 0), close * 0.015) / close'), 0), -10, 10)} AS atr_norm_ret_5d, realized_vol_5d, realized_vol_20d,
 CAST({flag(f"realized_vol_20d > {quant('realized_vol_20d', 0.5, 120, 30)}")} AS DOUBLE) AS vol_regime, f_vol_ratio AS vol_ratio, CAST(obv_rising AS DOUBLE) AS obv_rising,
 {clip(fill('f_vol_ratio * sign(close - pc)', 0), -5, 5)} AS vol_price_trend, {clip(fill(div(roll('sum', 'mfv', 20, 5), roll('sum', 'zv', 20, 5)), 0), -1, 1)} AS cmf_20,
 {', '.join(f"{clip(change('close', c), -0.3, 0.3)} AS ret_{n}d" for n, c in ((1, 'c1'), (3, 'c3'), (5, 'c5'), (10, 'c10'), (20, 'c20')))},
 {clip(fill(div('abs(close - open)', SPAN), 0.5), 0, 1)} AS body_ratio, {clip(fill(div('high - greatest(close, open)', SPAN), 0), 0, 1)} AS upper_wick,
 {clip(fill(div('least(close, open) - low', SPAN), 0), 0, 1)} AS lower_wick, CAST(sign(close - open) AS DOUBLE) AS candle_direction,
 {clip(fill(change('sm7', 'sm7l'), 0), -0.3, 0.3)} AS sg_momentum_5d, {clip(fill(change('sm13', 'sm13l'), 0), -0.3, 0.3)} AS sg_momentum_10d,
 {clip('CASE WHEN abs(close) > 1e-8 THEN acc15 / close ELSE 0 END', -0.01, 0.01)} AS sg_accel,
 {fill('pcr5', 1)} AS pcr_5d, iv_rank_level / 100 AS iv_rank, {clip('(close - coalesce(max_pain, close)) / close', -0.1, 0.1)} AS max_pain_dist,
 (sentiment - 50) / 50 AS news_sentiment_1d, (sent5 - 50) / 50 AS news_sentiment_5d, (sentiment - sent5) / 50 AS news_momentum,
 (vix - 15) / 10 AS vix_level, {clip(fill(change('vix', 'vix5'), 0), -0.5, 0.5)} AS vix_change_5d, CAST({flag('adx > 25')} AS DOUBLE) AS regime_trending,
 {fill(pct_rank('vix', 'vixs', 60), 0.5)} AS vix_percentile, {clip(fill(div('tv', roll('avg', 'tv', 20, 5)), 1), 0, 20)} AS inst_participation,
 {clip(fill(div(roll('avg', 'am', 10, 3), quant('am', 0.5, 20, 5)), 1), 0, 10)} AS amihud_illiquidity, {fill(pct_rank('tv', 'tvs', 60), 0.5)} AS volume_clock,
 {clip(fill(div('fe', quant('abs(fe)', 0.5, 20, 5)), 0), -10, 10)} AS force_index_5d, parkinson_vol_10d,
 {clip(fill(div('parkinson_vol_10d', 'realized_vol_20d'), 1), 0, 5)} AS vol_expansion,
 {clip(fill(div(fill(change('close', 'c5'), 0), 'parkinson_vol_10d'), 0), -10, 10)} AS vol_adjusted_mom,
 {clip('CASE WHEN rn < 5 THEN 0 ELSE coalesce(slope, 0) END', -0.05, 0.05)} AS linreg_slope_norm,
 CASE WHEN rn < 5 THEN 0 ELSE greatest(CAST(0 AS DOUBLE), coalesce(r2, 0)) END AS linreg_r2,
 {clip(fill(div('vwl - vws', 'close'), 0), -0.05, 0.05)} AS vwmacd_hist,
 {clip(fill(change('close', 'c20'), 0), -0.5, 0.5)} * CASE WHEN rn < 5 THEN 0 ELSE greatest(CAST(0 AS DOUBLE), coalesce(r2, 0)) END AS momentum_quality,
 gap_pct, {fill(roll('avg', 'sign(gap_pct)', 5, 2), 0)} AS gap_5d_persistence, {clip(fill(div('close - low', SPAN), 0.5), 0, 1)} AS close_loc,
 {clip(fill(div('high - close', SPAN), 0.5), 0, 1)} AS spread_pressure,
 CASE WHEN rn <= 20 OR NOT hv1 > 0 OR hv2 IS NULL THEN CAST(0.5 AS DOUBLE) WHEN hv2 > 0 THEN {clip('ln(hv2 / (2 * hv1 + CAST(1e-12 AS DOUBLE))) / (2 * ln(2))', 0, 1)} ELSE 0 END AS hurst_exponent_20,
 {clip(fill(div('abs(close - c20)', roll('sum', 'ad', 20, 5)), 0.5), 0, 1)} AS trend_efficiency,
 {clip(f"({flag('low < lo20 AND close > lo20')} - {flag('high > hi20 AND close < hi20')}) * f_vol_ratio", -5, 5)} AS liquidity_sweep FROM f2)""",
])

# Level/velocity filter with its covariance, step by step.
KALMAN = """kal AS (SELECT s.symbol, s.rn, z + (p00 / (p00 + CAST(0.005 AS DOUBLE))) * 0 AS lvl, CAST(0 AS DOUBLE) AS vel, CAST(0 AS DOUBLE) AS miss,
 (1 - p00 / (p00 + CAST(0.005 AS DOUBLE))) * p00 AS p00, (1 - p00 / (p00 + CAST(0.005 AS DOUBLE))) * p01 AS p01, p11 - p01 / (p00 + CAST(0.005 AS DOUBLE)) * p01 AS p11
 FROM (SELECT symbol, rn, zscore AS z, CAST(2.0001 AS DOUBLE) AS p00, CAST(1 AS DOUBLE) AS p01, CAST(1.0001 AS DOUBLE) AS p11 FROM f1 WHERE rn = 1) s
UNION ALL
 SELECT symbol, rn, lvl + vel + a00 / v * (z - lvl - vel), vel + a01 / v * (z - lvl - vel), abs(z - lvl - vel),
 (1 - a00 / v) * a00, (1 - a00 / v) * a01, a11 - a01 / v * a01
 FROM (SELECT s.symbol, s.rn, s.zscore AS z, r.lvl, r.vel, r.p00 + 2 * r.p01 + r.p11 + CAST(0.0001 AS DOUBLE) AS a00, r.p01 + r.p11 AS a01,
  r.p11 + CAST(0.0001 AS DOUBLE) AS a11, r.p00 + 2 * r.p01 + r.p11 + CAST(0.0051 AS DOUBLE) AS v
  FROM kal r JOIN f1 s ON s.symbol = r.symbol AND s.rn = r.rn + 1)),
kaf AS (SELECT kal.symbol, kal.rn, CAST(sign(vel) AS DOUBLE) AS kalman_trend,
 coalesce(CASE WHEN kal.rn >= 5 THEN avg(vel) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) END, 0) AS kalman_velocity,
 least(greatest(miss / greatest(abs(lvl), CAST(1e-8 AS DOUBLE)), 0), 1) AS noise_ratio FROM kal)"""
