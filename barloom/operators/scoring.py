"""Composite technical score, regimes, signal labels, scans and rankings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import IndicatorConfig
from barloom.functions.cols import Series, clip, div, fill, flag, ladder, num

C = F.col
CFG = IndicatorConfig()


def tech_score(ind: DataFrame, cfg: IndicatorConfig = CFG) -> DataFrame:
    """Six ladders, weighted and normalised to 0..100, with the confirmations of the steps taken."""
    rsi, hist = fill(C("rsi"), 50), fill(C("macd_hist"), 0)
    pct, vol, fib = fill(C("bb_pct"), 0.5), fill(C("vol_ratio"), 1), fill(C("fib_score"), 0)

    def on(name):
        return F.coalesce(C(name) == 1, F.lit(False))

    # (score column, weight, [(condition, score, bull, bear)], else score)
    ladders = {
        "rsi": (cfg.weight_rsi, [
            (rsi < cfg.rsi_oversold, num(1), 1, 0), (rsi < 45, num(0.6), 0, 0),
            (rsi > cfg.rsi_overbought, num(-1), 0, 1)], F.greatest(num(0), (50 - rsi) / 50)),
        "macd": (cfg.weight_macd, [
            (on("macd_bullish"), num(1), 1, 0), (hist > 0, num(0.5), 0, 0),
            (on("macd_bearish"), num(-1), 0, 1)], num(0)),
        "bb": (cfg.weight_bb, [
            (on("bb_touch_lower"), num(1), 1, 0), (pct < 0.2, num(0.6), 0, 0),
            (on("bb_touch_upper"), num(-1), 0, 1), (on("bb_squeeze"), num(0.3), 0, 0)], num(0)),
        "volume": (cfg.weight_volume, [
            (on("vol_spike"), num(0.8), 1, 0), (vol > 1.2, num(0.4), 0, 0)], num(0)),
        "fibonacci": (cfg.weight_fib, [(fib > 0.5, fib, 1, 0)], fib),
        "ema_trend": (cfg.weight_ema, [
            (on("ema_golden"), num(1), 1, 0), (on("ema_cross"), num(0.5), 0, 0),
            (on("ema_death"), num(-1), 0, 1)], num(0)),
    }
    cols, bull, bear, raw, top = {}, F.lit(0), F.lit(0), num(0), 0.0
    for name, (weight, steps, other) in ladders.items():
        cols[f"_sc_{name}"] = ladder([(c, v) for c, v, _, _ in steps], other)
        bull = bull + ladder([(c, b) for c, _, b, _ in steps], 0)
        bear = bear + ladder([(c, b) for c, _, _, b in steps], 0)
        raw = raw + C(f"_sc_{name}") * weight
        top += weight
    out = ind.withColumns({**cols, "confirmations": bull, "bear_confirmations": bear})
    out = out.withColumn("score", clip((raw + top) / (2 * top) * 100, 0, 100))
    score = C("score")
    label = ladder([
        ((C("confirmations") >= cfg.min_confirmations) & (score >= 75), "STRONG BUY"),
        (score >= 60, "BUY"),
        ((C("bear_confirmations") >= cfg.min_confirmations) & (score <= 25), "STRONG SELL"),
        (score <= 40, "SELL")], "HOLD")
    parts = F.struct(*[F.round(C(f"_sc_{n}") * (w * 100), 1).alias(n) for n, (w, _, _) in ladders.items()])
    out = out.withColumns({
        "tech_score": F.round(score, 1), "signal": label, "breakdown": parts,
        "stop_loss": F.round(F.coalesce("stop_loss", C("close") * 0.97), 2),
        "take_profit": F.round(F.coalesce("take_profit", C("close") * 1.05), 2)})
    return out.drop(*cols)


def model_signal(df: DataFrame, prob: str = "prob") -> DataFrame:
    p = C(prob)
    return df.withColumn("model_signal", ladder([
        (p >= 0.68, "STRONG BUY"), (p >= 0.55, "BUY"), (p <= 0.32, "STRONG SELL"), (p <= 0.45, "SELL")], "HOLD"))


def kelly(df: DataFrame, prob: str = "prob", sharpe: str = "sharpe", vol: str = "vol") -> DataFrame:
    p = C(prob)
    edge = (p - 0.5) / F.greatest(num(0.01), 1 - p) * 0.5
    return df.withColumns({"kelly_fraction": clip(edge, 0, 0.25),
                           "expected_return": C(sharpe) * C(vol) * math.sqrt(5)})


# Regime name and the weights of boosted trees, forest and sequence model.
REGIME_WEIGHTS = {
    "trending": (0.55, 0.20, 0.25),
    "trending_vol": (0.40, 0.25, 0.35),
    "mean_reverting": (0.25, 0.50, 0.25),
    "high_vol_chop": (0.33, 0.34, 0.33),
}


def regime(df: DataFrame, vix: str = "vix", adx: str = "adx") -> DataFrame:
    """Regime label and ensemble weights from volatility level and trend strength."""
    trend, wild = C(adx) > 25, C(vix) > 20
    out = df.withColumn("regime", ladder([
        (trend & ~wild, "trending"), (trend, "trending_vol"), (~wild, "mean_reverting")], "high_vol_chop"))
    names = ("w_boost", "w_forest", "w_sequence")
    return out.withColumns({
        col: ladder([(C("regime") == r, num(w[i])) for r, w in REGIME_WEIGHTS.items()], num(0))
        for i, col in enumerate(names)})


def daily_regime(ind: DataFrame, vix: DataFrame) -> DataFrame:
    """One market regime per date from the volatility level and the mean ADX of all symbols."""
    days = ind.groupBy("ts").agg(F.avg("adx").alias("_adx")).join(vix, "ts", "left")
    v, a = fill(C("vix"), 15), fill(C("_adx"), 20)
    return days.select("ts", v.alias("vix"), a.alias("mean_adx"), ladder([
        (v > 25, "high_vol_crisis"), ((a > 25) & (v < 20), "trending"), (a < 20, "mean_reverting")],
        "normal").alias("market_regime"))


def latest(df: DataFrame, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Last row per key, by a map-side combined aggregate (no window over whole keys)."""
    rest = [c for c in df.columns if c != by]
    last = df.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(by, *[C(f"_r.{c}").alias(c) for c in rest])


def scan(scored: DataFrame, news: DataFrame, top_n: int = 10, least: int = 50,
         news_weight: float = CFG.weight_news) -> DataFrame:
    """Latest row of every symbol with enough history, blended with its news score, best first."""
    # `least` bars of history come with the same aggregate as the latest row
    rest = [c for c in scored.columns if c != "symbol"]
    last = (scored.groupBy("symbol")
            .agg(F.max_by(F.struct(*rest), "ts").alias("_r"), F.count(F.lit(1)).alias("_n"))
            .filter(C("_n") >= least).select("symbol", "_r.*"))
    out = last.join(news, "symbol", "left").withColumn("news_score", fill(C("news_score"), 50))
    blend = C("tech_score") * (1 - news_weight) + C("news_score") * news_weight
    return (out.withColumn("combined_score", F.round(blend, 1))
            .orderBy(F.desc("combined_score"), "symbol").limit(top_n))


def daily_candidates(scored: DataFrame, regimes: DataFrame, k: int = 10, min_score: float = 60.0,
                     min_prob: float = 0.55) -> DataFrame:
    """Top k symbols per date by blended rank, with a higher bar in a crisis."""
    df = scored.join(regimes.select("ts", "market_regime"), "ts")
    bar = F.when(C("market_regime") == "high_vol_crisis", num(min_score * 1.1)).otherwise(num(min_score))
    df = df.filter((C("tech_score") >= bar) & (C("prob") >= min_prob))
    df = df.withColumn("rank_score", C("tech_score") * 0.6 + C("prob") * 40)
    spot = Window.partitionBy("ts").orderBy(F.desc("rank_score"), "symbol")
    return df.withColumn("rank", F.row_number().over(spot)).filter(C("rank") <= k)


def signal_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def scan_counts(scored: DataFrame) -> DataFrame:
    """Per scan date: buys, sells and holds."""
    return scored.groupBy("ts").agg(
        F.count_if(C("signal").contains("BUY")).alias("buys"),
        F.count_if(C("signal").contains("SELL")).alias("sells"),
        F.count_if(C("signal") == "HOLD").alias("holds"))


def signal_report(scored: DataFrame, top: int = 8) -> DataFrame:
    return scored.orderBy(F.desc("tech_score"), "symbol", "ts").limit(top)


def blend(df: DataFrame, members: dict[str, str], weights: dict[str, str], sequence: str = "seq_prob",
          sequence_weight: str = "w_sequence") -> DataFrame:
    """Weighted mean of the members present, then mixed with the sequence score if there is one."""
    have = {m: F.when(C(p).isNotNull(), C(weights[m])) for m, p in members.items()}
    total = sum((fill(C(p) * C(weights[m]), 0) for m, p in members.items()), num(0))
    mass = sum((fill(w, 0) for w in have.values()), num(0))
    tab = div(total, mass)
    w = C(sequence_weight)
    return df.withColumn("prob", F.when(C(sequence).isNotNull(), tab * (1 - w) + C(sequence) * w).otherwise(tab))


def gate(signals: DataFrame, slider: float = 1.0) -> DataFrame:
    """Only strong signals with confidence 70 or more; size is the scaled Kelly fraction up to 0.10."""
    return signals.filter(C("signal").isin("STRONG BUY", "STRONG SELL") & (C("confidence") >= 70)).withColumn(
        "size", F.least(num(0.10), C("kelly_fraction") * slider))
