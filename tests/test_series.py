"""Indicators, features and labels on hand-made series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import IndicatorConfig
from barloom.functions import longseries, recur
from barloom.functions.cols import by_series
from barloom.operators import features as fe
from barloom.operators import indicators as ind
from barloom.operators import labels

RNG = np.random.default_rng(7)
WALK = list(100 + RNG.normal(0, 1, 1300).cumsum())


def frame(df, *cols):
    return df.select("symbol", "ts", *cols).orderBy("symbol", "ts").toPandas()


def test_recurrences_match_pandas(make_bars):
    out = frame(ind.run(make_bars({"A": WALK}), [ind.EMA, ind.MACD, ind.ATR], ind.CFG), "close", "ema_slow", "macd_signal", "atr")
    c = out["close"]
    slow = c.ewm(span=21, adjust=False, min_periods=21).mean()
    line = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    signal = line.ewm(span=9, adjust=False, min_periods=9).mean()
    assert np.allclose(out["ema_slow"], slow, equal_nan=True) and np.allclose(out["macd_signal"], signal, equal_nan=True)
    assert (out["atr"][:13] == 0).all() and (out["atr"][13:] > 0).all()


def test_split_series_gives_the_same(make_bars):
    """Unsplit against parts of 1,024 rows, including totals and states with unbounded memory."""
    bars = make_bars({"A": WALK * 2, "B": WALK[:300]})
    fams = [ind.EMA, ind.RSI, ind.ADX, ind.OBV, ind.OBV_TREND, ind.SUPERTREND, ind.FIBONACCI]
    cols = ["ema_slow", "rsi", "adx", "obv", "obv_ema", "supertrend_bull", "fib_high"]
    whole = frame(ind.run(bars, fams, ind.CFG), *cols)
    parts = longseries.split_series(bars, rows=1024, halo=1024, bucket="month")
    split = frame(longseries.merge_series(ind.run(parts, fams, ind.CFG)), *cols)
    assert len(whole) == len(split) == 2900
    for c in cols:
        assert np.allclose(whole[c], split[c], equal_nan=True), c


def test_forward_fill_across_parts(make_bars):
    bars = make_bars({"A": range(3000)}).withColumn("x", F.when(F.col("close") == 5, 1.0))
    parts = longseries.split_series(bars, rows=1024, halo=1024, bucket="month")
    out = longseries.merge_series(longseries.forward_fill(parts, ["x"]))
    assert out.filter("x = 1").count() == 2995


def test_features_do_not_look_ahead(make_bars):
    bars = make_bars({"A": WALK[:400], "B": WALK[400:800]})
    whole = fe.features(bars).filter("ts <= '2020-10-01'")
    cut = fe.features(bars.filter("ts <= '2020-10-01' AND symbol = 'A'"))
    a, b = frame(whole.filter("symbol = 'A'"), *fe.FEATURES), frame(cut, *fe.FEATURES)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_flat_and_quadratic(make_bars):
    flat = frame(fe.features(make_bars({"A": [50.0] * 60}, spread=0.0)), *fe.FEATURES)
    assert not flat.isna().any().any()
    assert (flat["rsi"][14:] == 1).all() and (flat["linreg_r2"] == 0).all()
    weights = fe.edge_weights(7, 2)
    assert weights == pytest.approx([.761905, .357143, .071429, -.095238, -.142857, -.071429, .119048], abs=1e-6)
    y = [float(t * t) for t in range(20)]
    assert sum(w * y[19 - i] for i, w in enumerate(weights)) == pytest.approx(y[19])


def test_barrier_order_and_tail(spark, make_bars):
    bars = make_bars({"A": [100.0] * 12}).withColumn("atr", F.lit(1.0))
    both = bars.withColumns({"high": F.when(F.dayofmonth("ts") == 2, 103.0).otherwise(100.5),
                             "low": F.when(F.dayofmonth("ts") == 2, 98.0).otherwise(99.5)})
    out = frame(labels.triple_barrier(both), "label")
    assert out["label"].tolist() == [1, 0] + [0] * 10


@pytest.fixture(scope="module")
def long_walk(spark):
    """5,000 bars of one symbol as closes, and the same with nulls, a long gap among them."""
    close = 100 + np.random.default_rng(3).normal(0, 1, 5000).cumsum()
    holes = close.copy()
    holes[RNG.random(5000) < 0.3] = np.nan
    holes[:4] = holes[1000:2200] = np.nan
    days = pd.date_range("2000-01-01", periods=5000).date
    rows = [("A", d, float(a), None if np.isnan(b) else float(b)) for d, a, b in zip(days, close, holes, strict=True)]
    return spark.createDataFrame(rows, "symbol string, ts date, close double, x double"), pd.Series(close), pd.Series(holes)


SPANS = (1, 2, 9, 26, 50, 200, 500)


def test_recurrences_are_exact_for_every_span(long_walk):
    df, close, _ = long_walk
    out = recur.scan(recur.indexed(by_series(df)), {f"e{n}": recur.span_ema("close", n, least=1) for n in SPANS})
    out = frame(out, *[f"e{n}" for n in SPANS])
    for n in SPANS:
        assert np.abs(out[f"e{n}"] - close.ewm(span=n, adjust=False).mean()).max() < 1e-9, n


@pytest.mark.parametrize("span", SPANS)
def test_nulls_repeat_and_age_the_mean(long_walk, span):
    df, _, holes = long_walk
    out = frame(recur.exponential_mean(df, "x", "e", span), "e")["e"].astype(float)
    expected = holes.ewm(span=span, adjust=False, ignore_na=False).mean()
    assert np.allclose(out, expected, atol=1e-9, rtol=0, equal_nan=True)


def test_split_series_with_a_long_period(spark, make_bars):
    """Two hundred rows of period: the copied edge follows from it."""
    cfg = IndicatorConfig(ema_slow=100, macd_slow=100)
    bars = make_bars({"A": WALK * 8})
    halo = longseries.halo_rows(cfg)
    parts = longseries.split_series(bars, rows=halo + 10, bucket="month", cfg=cfg)
    whole = frame(ind.run(bars, [ind.EMA, ind.MACD], cfg), "ema_slow", "macd_signal")
    split = frame(longseries.merge_series(ind.run(parts, [ind.EMA, ind.MACD], cfg)), "ema_slow", "macd_signal")
    for c in ("ema_slow", "macd_signal"):
        assert np.allclose(whole[c], split[c], atol=1e-9, rtol=0, equal_nan=True)


def test_null_volumes_are_counted(make_bars):
    bars = make_bars({"A": WALK[:60]}).withColumn("volume", F.when(F.col("ts").isin(["2020-01-15", "2020-01-16"]), None).otherwise(F.col("volume")))
    out = frame(ind.run(bars, [ind.VOLUME_RATIO], ind.CFG), "vol_ratio")["vol_ratio"]
    assert out[:35].isna().all() and (out[35:] == 1).all()
