"""Indicator queries over the whole bars view."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.plans.registry import query, tidy
from barloom.plans.sql_base import BARS, FIB_LEVEL, FIB_SCORE, W, clip, ema, indicator_sql, recursion, rnd, with_
from barloom.sources import tables

# name -> (operator, double columns, flag columns)
TABLE = {
    "ema_pair": (ind.ema_pair, ["ema_fast", "ema_slow"], ["ema_cross", "ema_golden", "ema_death"]),
    "sma_long": (ind.sma, ["sma200"], ["above_sma200"]),
    "rolling_vwap": (ind.vwap, ["vwap"], ["above_vwap"]),
    "rsi": (ind.rsi, ["rsi"], ["rsi_oversold", "rsi_overbought", "rsi_bull_div"]),
    "macd": (ind.macd, ["macd", "macd_signal", "macd_hist"], ["macd_bullish", "macd_bearish"]),
    "stochastic_rsi": (ind.stoch_rsi, ["stochrsi_k", "stochrsi_d"], ["stochrsi_oversold"]),
    "bollinger_bands": (ind.bollinger, ["bb_upper", "bb_lower", "bb_mid", "bb_width", "bb_pct"],
                        ["bb_squeeze", "bb_touch_lower", "bb_touch_upper"]),
    "average_true_range": (ind.atr, ["atr", "stop_loss", "take_profit"], []),
    "directional_index": (ind.adx, ["adx", "adx_pos", "adx_neg"], ["trending"]),
    "supertrend": (ind.supertrend, [], ["supertrend_bull"]),
    "williams_r": (ind.williams, ["williams_r"], ["williams_oversold", "williams_overbought"]),
    "commodity_channel": (ind.cci, ["cci"], ["cci_oversold", "cci_overbought"]),
    "on_balance_volume": (ind.obv, ["obv"], []),
    "obv_trend": (ind.obv_trend, ["obv", "obv_ema"], ["obv_rising"]),
    "volume_ratio": (ind.volume_ratio, ["vol_ratio"], ["vol_spike"]),
    "fibonacci_levels": (ind.fibonacci, ["fib_high", "fib_low", "fib_range", "fib_score", "fib_level"], []),
    "pivot_points": (ind.pivots, ["pivot_point", "pivot_r1", "pivot_s1", "pivot_r2", "pivot_s2"], ["near_support"]),
    "ichimoku_cloud": (ind.ichimoku, ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_span_a", "ichimoku_span_b"],
                       ["above_cloud", "below_cloud", "tk_cross_bull"]),
}
FORMULA = {"fib_score": f"{FIB_SCORE} AS fib_score", "fib_level": f"{FIB_LEVEL} AS fib_level"}


def _register(name, op, doubles, flags):
    @query(name, indicator_sql([FORMULA.get(d, d) for d in doubles], flags))
    def run(spark, sf_dir):
        return tidy(op(tables.bars(spark, sf_dir)), ["symbol", "ts", *doubles, *flags])


for _name, (_op, _d, _f) in TABLE.items():
    _register(_name, _op, _d, _f)

ALL_DOUBLES = [d for _, d, _ in TABLE.values() for d in d]
ALL_FLAGS = [f for _, _, f in TABLE.values() for f in f]


@query("all_indicators", indicator_sql([FORMULA.get(d, d) for d in dict.fromkeys(ALL_DOUBLES)], ALL_FLAGS))
def all_indicators(spark, sf_dir):
    return tidy(ind.indicators(tables.bars(spark, sf_dir)),
                ["symbol", "ts", *dict.fromkeys(ALL_DOUBLES), *ALL_FLAGS])


LONG_SPAN = 200


@query("ema_long", with_(BARS, f"e0 AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS rn FROM bars)",
                         recursion("er", "e0", {"e": ("close", ema(f"CAST(2 AS DOUBLE) / {LONG_SPAN + 1}"))}))
       + f"SELECT e0.symbol, e0.ts, {rnd(['e AS ema'], 6)} FROM e0 JOIN er ON e0.symbol = er.symbol AND e0.rn = er.rn")
def ema_long(spark, sf_dir):
    """A long exponential mean, as users set it: its memory reaches back thousands of rows."""
    from barloom.functions.recur import indexed, scan, span_ema
    from barloom.functions.cols import by_series
    out = scan(indexed(by_series(tables.bars(spark, sf_dir))), {"ema": span_ema("close", LONG_SPAN, least=1)})
    return tidy(out, ["symbol", "ts", "ema"], 6)


# A null repeats the mean and ages it: the state is the mean and the weight it has left.
GAPS = """g0 AS (SELECT symbol, ts, CASE WHEN ts = min(ts) OVER (PARTITION BY symbol, date_trunc('week', ts)) THEN close END AS x,
 row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
g1 AS (SELECT symbol, rn, CAST(x AS DOUBLE) AS e, CAST(1 AS DOUBLE) AS w FROM g0 WHERE rn = 1 UNION ALL
 SELECT s.symbol, s.rn, CASE WHEN s.x IS NULL THEN r.e WHEN r.e IS NULL THEN s.x ELSE (r.w * a.q * r.e + (1 - a.q) * s.x) / (r.w * a.q + 1 - a.q) END,
 CASE WHEN s.x IS NULL THEN r.w * a.q ELSE 1 END FROM g1 r JOIN g0 s ON s.symbol = r.symbol AND s.rn = r.rn + 1 CROSS JOIN (SELECT 1 - CAST(2 AS DOUBLE) / 22 AS q) a)"""


@query("ema_gaps", with_(BARS, GAPS) + f"SELECT g0.symbol, g0.ts, {rnd(['e AS ema'], 6)} FROM g0 JOIN g1 ON g0.symbol = g1.symbol AND g0.rn = g1.rn")
def ema_gaps(spark, sf_dir):
    """Exponential mean of weekly readings on the daily calendar: most rows are null."""
    from pyspark.sql import Window

    from barloom.functions.recur import exponential_mean
    b = tables.bars(spark, sf_dir)
    first = F.min("ts").over(Window.partitionBy("symbol", F.date_trunc("week", "ts")))
    weekly = b.withColumn("x", F.when(F.col("ts") == first, F.col("close")))
    return tidy(exponential_mean(weekly, "x", "ema", 21), ["symbol", "ts", "ema"], 6)


A12, A26, A9 = (f"CAST(2 AS DOUBLE) / {n + 1}" for n in (12, 26, 9))
SMOOTH = [f"""s0 AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS rn, greatest(close - lag(close) OVER ({W}), 0) AS g, greatest(lag(close) OVER ({W}) - close, 0) AS d FROM bars),
s1 AS (SELECT symbol, ts, close, rn, coalesce(g, 0) AS g, coalesce(d, 0) AS d FROM s0)""",
          recursion("q1", "s1", {"cs": ("close", ema("CAST(0.15 AS DOUBLE)")), "rg": ("g", ema("CAST(1 AS DOUBLE) / 14")), "rd": ("d", ema("CAST(1 AS DOUBLE) / 14"))}),
          f"""s2 AS (SELECT symbol, rn, cs, rg, rd, coalesce(greatest(cs - lag(cs) OVER (PARTITION BY symbol ORDER BY rn), 0), 0) AS sg,
 coalesce(greatest(lag(cs) OVER (PARTITION BY symbol ORDER BY rn) - cs, 0), 0) AS sd FROM q1)""",
          recursion("q2", "s2", {"f12": ("cs", ema(A12)), "f26": ("cs", ema(A26)), "eg": ("sg", ema("CAST(1 AS DOUBLE) / 14")), "ed": ("sd", ema("CAST(1 AS DOUBLE) / 14"))}),
          """s3 AS (SELECT symbol, rn, cs, CASE WHEN rn < 14 THEN NULL WHEN ed = 0 THEN 100 ELSE 100 - 100 / (1 + eg / ed) END AS rsi_clean,
 CASE WHEN rn < 14 THEN NULL WHEN rd = 0 THEN 100 ELSE 100 - 100 / (1 + rg / rd) END AS rsi_raw, CASE WHEN rn >= 26 THEN f12 - f26 END AS m FROM q2 JOIN s2 USING (symbol, rn))""",
          recursion("q3", "s3", {"sg9": ("m", ema(A9))})]


@query("smoothed_close", with_(BARS, *SMOOTH) + f"""SELECT symbol, ts, {rnd(['cs AS close_smooth', 'rsi_clean', clip('rsi_clean - rsi_raw', -20, 20) + ' AS rsi_divergence', 'CASE WHEN rn >= 34 THEN m - sg9 END AS macd_clean_hist'])}
 FROM s3 JOIN q3 USING (symbol, rn) JOIN s1 USING (symbol, rn)""")
def smoothed_close(spark, sf_dir):
    """Strength, histogram and divergence on a causally smoothed close."""
    return tidy(ind.smoothed_close(tables.bars(spark, sf_dir)), ["symbol", "ts", "close_smooth", "rsi_clean", "rsi_divergence", "macd_clean_hist"])
