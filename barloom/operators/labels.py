"""Forward-looking labels and targets. All look at most `horizon` rows ahead within one series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import Series, clip, div, flag, ladder, num

C = F.col


def floored_atr(atr: str):
    return F.greatest(C(atr), C("close") * 0.005)


def trend_quality(df: DataFrame, horizon: int = 10, atr: str = "atr") -> DataFrame:
    """1 where the move over `horizon` beats 0.30 ATR, holds at the midpoint and comes with volume."""
    s = Series(df)
    out = df.withColumns({
        "_end": s.lead("close", horizon), "_mid": s.lead("close", horizon // 2),
        "_more": s.lead("close", horizon + 1),
        "_peak": F.max("volume").over(s.rows(1, horizon)), "_usual": s.mean("volume", 20, 5),
    })
    gain = (C("_end") - C("close")) / C("close") / (floored_atr(atr) / C("close"))
    usual = F.when(C("_usual") > 0, C("_usual")).otherwise(num(1e-8))
    good = (gain > 0.30) & (C("_mid") > C("close") * 0.998) & (C("_peak") > usual * 1.1)
    return out.withColumn("label", flag(C("_more").isNotNull() & good)).drop(
        "_end", "_mid", "_more", "_peak", "_usual")


def triple_barrier(df: DataFrame, up: float = 2.0, down: float = 1.0, hold: int = 10,
                   atr: str = "atr") -> DataFrame:
    """1 where the upper barrier is met first (tested before the lower one in a bar), else 0;
    without a hit, the sign of the move. Rows with fewer than `hold` bars ahead give 0."""
    s = Series(df)
    ahead = {f"_{c}{i}": s.lead(c, i) for i in range(1, hold + 1) for c in ("high", "low")}
    out = df.withColumns({**ahead, "_end": s.lead("close", hold)})
    top, floor = C("close") + floored_atr(atr) * up, C("close") - floored_atr(atr) * down
    met = ladder([step for i in range(1, hold + 1) for step in ((C(f"_high{i}") >= top, True), (C(f"_low{i}") <= floor, False))],
                 C("_end") > C("close"))
    return out.withColumn("label", flag(C("_end").isNotNull() & met)).drop(*ahead, "_end")


def sharpe_target(df: DataFrame, horizon: int = 5, risk_free: float = 0.065 / 252) -> DataFrame:
    """Annualised Sharpe ratio of the next `horizon` daily returns, within +-5."""
    s = Series(df)
    out = df.withColumns({"_ret": div("close", s.lag("close")) - 1, "_end": s.lead("close", horizon)})
    ahead = Series(out).rows(1, horizon)
    out = out.withColumns({"_m": F.avg("_ret").over(ahead), "_sd": F.stddev_pop("_ret").over(ahead)})
    value = clip((C("_m") - risk_free) / F.greatest(C("_sd"), num(1e-8)) * math.sqrt(252), -5, 5)
    return out.withColumn("target", F.when(C("_end").isNotNull(), value).otherwise(num(0))).drop(
        "_ret", "_end", "_m", "_sd")


def positive_rates(labelled: DataFrame) -> DataFrame:
    """Share of positive labels per symbol."""
    return labelled.groupBy("symbol").agg(F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n"))


def mean_positive_rate(labelled: DataFrame) -> DataFrame:
    """Mean over symbols of their positive rates."""
    return positive_rates(labelled).agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("symbols"))
