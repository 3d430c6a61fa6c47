"""The causal feature matrix: 80 columns per bar, from bars and optional market series.

Feature columns carry the prefix `f_` while they are built, because several share the
name of the indicator they rescale; `features` strips it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import IndicatorConfig
from barloom.functions.cols import Series, above_median, clip, div, edge_weights, fill, fir, flag, num, rank_pct, ratio
from barloom.functions.joins import asof_calendar
from barloom.functions.longseries import forward_fill
from barloom.functions.recur import Tracker, span_ema
from barloom.functions.stages import Carry, run
from barloom.operators import indicators as ind

CFG = IndicatorConfig()
C = F.col

# The feature names in vector order.
FEATURES = """
close_to_ema_fast close_to_ema_slow close_to_sma200 close_to_bb_upper close_to_bb_lower close_to_vwap
close_to_52w_high close_to_52w_low high_low_range
rsi rsi_divergence macd_hist macd_hist_accel stochrsi_k williams_r cci roc_5d roc_20d
ema_cross above_sma200 above_vwap adx supertrend_bull above_cloud hma_slope
bb_width bb_pct bb_squeeze atr_ratio atr_norm_ret_5d realized_vol_5d realized_vol_20d vol_regime
vol_ratio obv_rising vol_price_trend cmf_20
ret_1d ret_3d ret_5d ret_10d ret_20d
body_ratio upper_wick lower_wick candle_direction
sg_momentum_5d sg_momentum_10d sg_accel kalman_trend kalman_velocity noise_ratio
pcr_5d iv_rank max_pain_dist news_sentiment_1d news_sentiment_5d news_momentum
vix_level vix_change_5d regime_trending vix_percentile
inst_participation amihud_illiquidity volume_clock force_index_5d
parkinson_vol_10d vol_expansion vol_adjusted_mom
linreg_slope_norm linreg_r2 vwmacd_hist momentum_quality
gap_pct gap_5d_persistence close_loc spread_pressure
hurst_exponent_20 trend_efficiency liquidity_sweep
""".split()

# Market series and what stands in for a missing value.
MARKET_DEFAULTS = {"pcr": 1.0, "iv_rank_level": 50.0, "max_pain": None, "sentiment": 50.0, "vix": 15.0}


def change(a: Column, b: Column) -> Column:
    return div(a, b) - 1


def highest(parts: list[Column]) -> Column:
    return F.greatest(*parts)


def lowest(parts: list[Column]) -> Column:
    return F.least(*parts)


LAGS = (1, 3, 5, 10, 20)

RETURNS = {
    0: lambda s, c: {f"_c{n}": s.lag("close", n) for n in LAGS},
    1: lambda s, c: {
        **{f"f_ret_{n}d": clip(change(C("close"), C(f"_c{n}")), -0.3, 0.3) for n in LAGS},
        "f_roc_5d": clip(fill(change(C("close"), C("_c5")), 0), -0.3, 0.3),
        "f_roc_20d": clip(fill(change(C("close"), C("_c20")), 0), -0.5, 0.5),
        "_ret": change(C("close"), C("_c1")),
    },
}

RANGES = {
    0: lambda s, c: {"_h21": s.high("close", 21, 1), "_l21": s.low("close", 21, 1)},
    2: lambda s, c: {"_h252": s.parts(highest, "close", "_h21", 21, 252, 50), "_l252": s.parts(lowest, "close", "_l21", 21, 252, 50)},
    3: lambda s, c: {
        "f_close_to_52w_high": ratio("close", "_h252"), "f_close_to_52w_low": ratio("close", "_l252"),
        "f_high_low_range": clip(fill(div(F.nullif(C("high") - C("low"), num(0)), "close"), 0.02), 0, 0.15),
    },
}

VOLATILITY = {
    2: lambda s, c: {"f_realized_vol_5d": fill(s.std("_ret", 5), 0.015),
                     "f_realized_vol_20d": fill(s.std("_ret", 20), 0.015)},
    6: lambda s, c: {"_vols": s.values("f_realized_vol_20d", 120)},
    8: lambda s, c: {"f_vol_regime": flag(above_median("f_realized_vol_20d", "_vols", 30)).cast("double")},
}


def _candles(s: Series, c) -> dict:
    span = C("high") - C("low")
    return {
        "f_body_ratio": clip(fill(div(F.abs(C("close") - C("open")), span), 0.5), 0, 1),
        "f_upper_wick": clip(fill(div(C("high") - F.greatest("close", "open"), span), 0), 0, 1),
        "f_lower_wick": clip(fill(div(F.least("close", "open") - C("low"), span), 0), 0, 1),
        "f_candle_direction": F.signum(C("close") - C("open")),
        "f_close_loc": clip(fill(div(C("close") - C("low"), span), 0.5), 0, 1),
        "f_spread_pressure": clip(fill(div(C("high") - C("close"), span), 0.5), 0, 1),
    }


CANDLES = {1: _candles}

# `_nv` volume with zero as missing; `_tv` turnover.
VOLUME = {
    1: lambda s, c: {
        "_zv": F.nullif("volume", num(0)), "_tv": C("close") * F.nullif("volume", num(0)),
        "_mfv": div(C("close") - C("low") - (C("high") - C("close")), C("high") - C("low"))
        * F.nullif("volume", num(0)),
    },
    2: lambda s, c: {
        "f_vol_ratio": clip(fill(div("_zv", s.mean("_zv", 20, 5)), 1), 0, 10),
        "f_cmf_20": clip(fill(div(s.total("_mfv", 20, 5), s.total("_zv", 20, 5)), 0), -1, 1),
        "f_inst_participation": clip(fill(div("_tv", s.mean("_tv", 20, 5)), 1), 0, 20),
        "_tvs": s.values("_tv", 252),
    },
    3: lambda s, c: {
        "f_vol_price_trend": clip(fill(C("f_vol_ratio") * F.signum(C("close") - C("_pc")), 0), -5, 5),
        "f_volume_clock": fill(rank_pct("_tv", "_tvs", 60), 0.5),
        "_am": div(F.abs(fill(C("_ret"), 0)), "_tv"),
    },
    6: lambda s, c: {"_am10": s.mean("_am", 10, 3), "_am20": s.quantile("_am", 0.5, 20, 5)},
    8: lambda s, c: {"f_amihud_illiquidity": clip(fill(div("_am10", "_am20"), 1), 0, 10)},
}


def weighted_mean(s: Series, n: int) -> Column:
    return fir(s, "close", [w / (n * (n + 1) / 2) for w in range(n, 0, -1)])


HULL = {
    0: lambda s, c: {"_hull": weighted_mean(s, 5) * 2 - weighted_mean(s, 9)},
    2: lambda s, c: {"_hull1": s.lag("_hull")},
    3: lambda s, c: {"f_hma_slope": fill(F.signum(C("_hull") - C("_hull1")), 0)},
}

EDGE = {
    0: lambda s, c: {
        "_e7": F.coalesce(fir(s, "close", edge_weights(7, 2)), C("close")),
        "_e13": F.coalesce(fir(s, "close", edge_weights(13, 3)), C("close")),
        "_e15": fill(fir(s, "close", edge_weights(15, 4, deriv=2)), 0),
    },
    2: lambda s, c: {"_e7l": s.lag("_e7", 5), "_e13l": s.lag("_e13", 10)},
    3: lambda s, c: {
        "f_sg_momentum_5d": clip(fill(change(C("_e7"), C("_e7l")), 0), -0.3, 0.3),
        "f_sg_momentum_10d": clip(fill(change(C("_e13"), C("_e13l")), 0), -0.3, 0.3),
        "f_sg_accel": clip(F.when(F.abs("close") > 1e-8, C("_e15") / C("close")).otherwise(num(0)), -0.01, 0.01),
    },
}

PARKINSON = {
    1: lambda s, c: {"_hl2": F.pow(F.ln(F.greatest(F.abs(F.nullif(div("high", "low"), num(0))), num(1e-6))), 2)},
    2: lambda s, c: {"f_parkinson_vol_10d": fill(F.sqrt(s.mean("_hl2", 10, 3) / (4 * math.log(2))), 0.015)},
    3: lambda s, c: {
        "f_vol_expansion": clip(fill(div("f_parkinson_vol_10d", "f_realized_vol_20d"), 1), 0, 5),
        "f_vol_adjusted_mom": clip(fill(div(fill(change(C("close"), C("_c5")), 0), "f_parkinson_vol_10d"), 0), -10, 10),
    },
}

TREND_LINE = {
    0: lambda s, c: {"_m20": s.mean("close", 20, 5)},
    1: lambda s, c: {"_cn": fill(div("close", "_m20"), 1)},
    2: lambda s, c: {
        "_sl": F.regr_slope("_cn", "_n").over(s.rows(-19, 0)),
        "_r2": F.when(F.var_pop("_cn").over(s.rows(-19, 0)) > 0, F.regr_r2("_cn", "_n").over(s.rows(-19, 0))),
    },
    3: lambda s, c: {
        "f_linreg_slope_norm": clip(F.when(C("_n") < 5, num(0)).otherwise(fill(C("_sl"), 0)), -0.05, 0.05),
        "f_linreg_r2": F.when(C("_n") < 5, num(0)).otherwise(F.greatest(num(0), fill(C("_r2"), 0))),
        "f_momentum_quality": clip(fill(change(C("close"), C("_c20")), 0), -0.5, 0.5)
        * F.when(C("_n") < 5, num(0)).otherwise(F.greatest(num(0), fill(C("_r2"), 0))),
    },
}

GAPS = {
    0: ind.previous,
    1: lambda s, c: {"f_gap_pct": clip(fill(div(C("open") - C("_pc"), "_pc"), 0), -0.1, 0.1)},
    2: lambda s, c: {"f_gap_5d_persistence": fill(s.mean(F.signum("f_gap_pct"), 5, 2), 0)},
}

# Variance ratio of 1- and 2-step log returns over the last 40 closes.
HURST = {
    0: lambda s, c: {
        "_r1": F.ln(F.greatest("close", num(1e-6))) - F.ln(F.greatest(s.lag("close"), num(1e-6)))},
    2: lambda s, c: {"_r2s": C("_r1") + s.lag("_r1"), "_v1": F.var_pop("_r1").over(s.rows(-38, 0))},
    6: lambda s, c: {"_v2": F.var_pop("_r2s").over(s.rows(-37, 0))},
    8: lambda s, c: {"f_hurst_exponent_20": hurst(s, 0.0)},
}


def hurst(s: Series, shift: float) -> Column:
    """Clipped to 0..1; `shift=0.5` centres a random walk at one half."""
    value = F.when(C("_v2") > 0, F.ln(C("_v2") / (C("_v1") * 2 + 1e-12)) / (2 * math.log(2)) + shift)
    return F.when((C("_n") <= 20) | ~(C("_v1") > 0) | C("_v2").isNull(), num(0.5)).otherwise(
        clip(fill(value, 0), 0, 1))


EFFICIENCY = {
    0: ind.previous,
    1: lambda s, c: {"_ad": F.abs(C("close") - C("_pc"))},
    2: lambda s, c: {"_path": s.total("_ad", 20, 5)},
    3: lambda s, c: {"f_trend_efficiency": clip(fill(div(F.abs(C("close") - C("_c20")), "_path"), 0.5), 0, 1)},
}

SWEEP = {
    0: lambda s, c: {"_low20": s.low("low", 20, 10, shift=1), "_high20": s.high("high", 20, 10, shift=1)},
    3: lambda s, c: {"f_liquidity_sweep": clip(
        (flag((C("low") < C("_low20")) & (C("close") > C("_low20")))
         - flag((C("high") > C("_high20")) & (C("close") < C("_high20")))) * C("f_vol_ratio"), -5, 5)},
}

FORCE = {
    0: ind.previous,
    1: lambda s, c: {"_force": fill((C("close") - C("_pc")) * C("volume"), 0)},
    4: lambda s, c: {"_fe": span_ema("_force", 5, least=1)},
    6: lambda s, c: {"_fs": s.quantile(F.abs("_fe"), 0.5, 20, 5)},
    8: lambda s, c: {"f_force_index_5d": clip(fill(div("_fe", "_fs"), 0), -10, 10)},
}


def _weighted_price(s: Series, n: int) -> Column:
    return div(s.total(C("close") * C("volume"), n, max(2, n // 3)), s.total(F.nullif("volume", num(0)), n, max(2, n // 3)))


VWMACD = {
    0: lambda s, c: {"_w12": _weighted_price(s, 12), "_w26": _weighted_price(s, 26)},
    1: lambda s, c: {"_w12p": Carry(("last", C("_w12"))), "_w26p": Carry(("last", C("_w26")))},
    2: lambda s, c: {"_w12f": F.coalesce(F.last("_w12", True).over(s.past), "_w12p", "close"),
                     "_w26f": F.coalesce(F.last("_w26", True).over(s.past), "_w26p", "close")},
    3: lambda s, c: {"_wl": C("_w12f") - C("_w26f")},
    4: lambda s, c: {"_ws": span_ema("_wl", 9, least=1)},
    8: lambda s, c: {"f_vwmacd_hist": clip(fill(div(C("_wl") - C("_ws"), "close"), 0), -0.05, 0.05)},
}

OSCILLATORS = {
    6: lambda s, c: {"_c5b": s.lag("close", 5), "_r5b": s.lag("rsi", 5)},
    8: lambda s, c: {
        "f_rsi": clip(fill(C("rsi") / 100, 0.5), 0, 1),
        "_lower": flag(C("close") < C("_c5b")), "_higher": flag(C("rsi") > C("_r5b")),
        "f_williams_r": clip(C("williams_r") / -100, 0, 1),
        "f_cci": clip(C("cci") / 200, -1, 1),
        "f_macd_hist": C("macd") - C("macd_signal"),
    },
    9: lambda s, c: {"_mh1": s.lag("macd_hist")},
    10: lambda s, c: {
        "f_rsi_divergence": (C("_lower") * C("_higher") - (1 - C("_lower")) * (1 - C("_higher"))).cast("double"),
        "f_macd_hist_accel": fill(C("macd_hist") - C("_mh1"), 0),
        "f_stochrsi_k": clip(C("stochrsi_k") / 100, 0, 1),
    },
}

ATR_RATIOS = {8: lambda s, c: {
    "f_atr_ratio": clip(F.coalesce(F.nullif("atr", num(0)), C("close") * 0.015) / C("close"), 0, 0.1),
    "f_atr_norm_ret_5d": clip(fill(div(
        change(C("close"), C("_c5")),
        F.coalesce(F.nullif("atr", num(0)), C("close") * 0.015) / C("close")), 0), -10, 10),
}}

TREND_STATE = {
    10: lambda s, c: {
        **{f"f_close_to_{k}": ratio("close", k) for k in
           ("ema_fast", "ema_slow", "sma200", "bb_upper", "bb_lower", "vwap")},
        **{f"f_{k}": C(k).cast("double") for k in ("ema_cross", "above_sma200", "above_vwap", "above_cloud",
                                                   "obv_rising", "bb_width", "bb_pct", "bb_squeeze")},
        "f_adx": clip(C("adx") / 50, 0, 1),
        "f_regime_trending": flag(C("adx") > 25).cast("double"),
    },
    12: lambda s, c: {"f_supertrend_bull": C("supertrend_bull").cast("double")},
}

MARKET = {
    0: lambda s, c: {"_pcr5": s.mean("pcr", 5), "_sent5": s.mean("sentiment", 5), "_vix5": s.lag("vix", 5),
                     "_vixs": s.values("vix", 252)},
    1: lambda s, c: {
        "f_pcr_5d": fill(C("_pcr5"), 1), "f_iv_rank": C("iv_rank_level") / 100,
        "f_max_pain_dist": clip((C("close") - F.coalesce("max_pain", "close")) / C("close"), -0.1, 0.1),
        "f_news_sentiment_1d": (C("sentiment") - 50) / 50,
        "f_news_sentiment_5d": (fill(C("_sent5"), 50) - 50) / 50,
        "f_news_momentum": (C("sentiment") - fill(C("_sent5"), 50)) / 50,
        "f_vix_level": (C("vix") - 15) / 10,
        "f_vix_change_5d": clip(fill(change(C("vix"), C("_vix5")), 0), -0.5, 0.5),
        "f_vix_percentile": fill(rank_pct("vix", "_vixs", 60), 0.5),
    },
}

# Rolling normalisation of close, the input of the level/velocity filter.
ZSCORE = {
    0: lambda s, c: {"_zm": s.mean("close", 60, 10), "_zs": s.std("close", 60, 10)},
    1: lambda s, c: {"zscore": (C("close") - fill(C("_zm"), 0))
                     / F.when(C("_zs") == 0, num(1)).otherwise(fill(C("_zs"), 1))},
}


def zscore(bars: DataFrame) -> DataFrame:
    return run(bars, [ZSCORE], CFG)


# Process and measurement variance of the filter.
KALMAN_Q, KALMAN_R = 1e-4, 5e-3


def kalman_gains(least: int = 8, most: int = 400) -> tuple[tuple[float, float], ...]:
    """Gains of the constant-velocity filter, row by row until they settle; they do not depend on data."""
    p00, p01, p11, out = 1.0, 0.0, 1.0, []
    while len(out) < most:
        a00, a01, a11 = p00 + 2 * p01 + p11 + KALMAN_Q, p01 + p11, p11 + KALMAN_Q
        k0, k1 = a00 / (a00 + KALMAN_R), a01 / (a00 + KALMAN_R)
        p00, p01, p11 = (1 - k0) * a00, (1 - k0) * a01, a11 - k1 * a01
        out.append((k0, k1))
        if len(out) > least and max(abs(k0 - out[-2][0]), abs(k1 - out[-2][1])) < 1e-16:
            break
    return tuple(out)


KALMAN = ZSCORE | {
    4: lambda s, c: {"_track": Tracker("zscore", kalman_gains())},
    6: lambda s, c: {"_ahead": s.lag(C("_track_level") + C("_track_velocity")), "_kv": s.mean("_track_velocity", 5)},
    8: lambda s, c: {
        "f_kalman_trend": F.signum("_track_velocity"), "f_kalman_velocity": fill(C("_kv"), 0),
        "f_noise_ratio": clip(fill(F.abs(C("zscore") - C("_ahead")), 0) / F.greatest(F.abs("_track_level"), num(1e-8)), 0, 1),
    },
}

WINDOWED = [RETURNS, RANGES, VOLATILITY, CANDLES, GAPS, VOLUME, HULL, EDGE, PARKINSON, TREND_LINE, HURST,
            EFFICIENCY, SWEEP]
RECURRENT = [FORCE, VWMACD, OSCILLATORS, ATR_RATIOS, TREND_STATE]


def with_market(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Attach market-wide daily series (ts and any of MARKET_DEFAULTS) as of each date; neutral when absent."""
    if market is not None:
        bars = asof_calendar(bars, market, MARKET_DEFAULTS)
    absent = [n for n in MARKET_DEFAULTS if n not in bars.columns]
    return bars.withColumns({n: F.lit(MARKET_DEFAULTS[n]).cast("double") for n in absent}) if absent else bars


def only(bars: DataFrame, *families: dict, base: list | None = None) -> DataFrame:
    """Selected families without the epilogue: (symbol, ts) and their feature columns."""
    out = run(bars, [*(base or []), *families], CFG)
    names = [c for c in out.columns if c.startswith("f_")]
    return out.select("symbol", "ts", *[C(c).alias(c[2:]) for c in names])


def features(bars: DataFrame, market: DataFrame | None = None,
             cfg: IndicatorConfig = CFG, keep: tuple = ("atr",)) -> DataFrame:
    """All 80 features after the epilogue (forward fill, 0, +-10), plus the bar and `keep` columns."""
    out = run(with_market(bars, market), [*ind.ALL, *WINDOWED, *RECURRENT, MARKET, KALMAN], cfg)
    bar = [c for c in ("symbol", "ts", "open", "high", "low", "close", "volume", "_part", "_side") if c in out.columns]
    out = out.select(*bar, *[C(k).alias(f"_keep_{k}") for k in keep],
                     *[C(f"f_{n}").cast("double").alias(n) for n in FEATURES])
    out = forward_fill(out, NULLABLE)
    return out.select(*bar, *[C(f"_keep_{k}").alias(k) for k in keep],
                      *[clip(fill(C(n), 0), -10, 10).alias(n) for n in FEATURES])


# Features that may be missing inside a series; all others have their own default.
NULLABLE = ["stochrsi_k", "williams_r", "cci", "bb_width", "bb_pct", "macd_hist",
            *[f"ret_{n}d" for n in LAGS]]
