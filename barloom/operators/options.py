"""Options analytics over contract tables and option chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import clip, div, fill, ladder, norm_cdf, norm_pdf, num

C = F.col
DAY = ["trade_date", "symbol"]


def is_call() -> Column:
    return C("option_type") == "CE"


def is_put() -> Column:
    return C("option_type") == "PE"


def nearest_expiry(contracts: DataFrame) -> DataFrame:
    """Contracts of the earliest expiry of each (date, symbol); the minimum is aggregated first."""
    first = contracts.groupBy(*DAY).agg(F.min("expiry_date").alias("expiry_date"))
    return contracts.join(first, [*DAY, "expiry_date"], "left_semi")


def by_strike(contracts: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Call and put open interest, and the call settle price, per strike."""
    return contracts.groupBy(*keys, "expiry_date", "strike").agg(
        F.sum(F.when(is_call(), C("open_int")).otherwise(0)).alias("call_oi"),
        F.sum(F.when(is_put(), C("open_int")).otherwise(0)).alias("put_oi"),
        F.max(F.when(is_call(), C("settle_price"))).alias("call_settle"))


def pcr(strikes: DataFrame, keys: list[str] = DAY, digits: int = 4) -> DataFrame:
    out = strikes.groupBy(*keys).agg(F.sum("call_oi").alias("call_oi"), F.sum("put_oi").alias("put_oi"))
    return out.withColumn("pcr", put_call(digits))


def put_call(digits: int = 4) -> Column:
    return F.round(C("put_oi") / F.greatest(F.lit(1), C("call_oi")), digits)


def busiest() -> Column:
    """Strike, expiry and call settle price with the highest combined open interest; the lowest strike of equals."""
    return F.max_by(F.struct("strike", "expiry_date", "call_settle"), F.struct(C("call_oi") + C("put_oi"), -C("strike")))


def atm(strikes: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Strike with the highest combined open interest; the lowest one of equals."""
    return strikes.groupBy(*keys).agg(busiest().alias("_a")).select(
        *keys, C("_a.strike").alias("atm_strike"), C("_a.expiry_date").alias("expiry_date"),
        C("_a.call_settle").alias("atm_settle"))


def atm_iv(df: DataFrame) -> DataFrame:
    """Volatility proxy in percent from the at-the-money call settle price."""
    years = F.greatest(F.lit(1), F.datediff("expiry_date", "trade_date")) / 365
    value = clip(C("atm_settle") / C("atm_strike") / F.sqrt(years) * 100, 3, 120)
    return df.withColumn("atm_iv", F.when((C("atm_strike") > 0) & (C("atm_settle") > 0), value).otherwise(num(0)))


def max_pain(strikes: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Strike with the least total payoff to option holders, the first of equals."""
    return with_pain(strikes, keys).groupBy(*keys).agg(
        F.min_by("strike", F.struct("_pain", "strike")).alias("max_pain"), F.min("_pain").alias("pain"))


def with_pain(strikes: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Adds `_pain`, the total payoff to option holders if the price expires at the strike.

    payoff(x) = x*sum(oi, k<x) - sum(oi*k, k<x) for calls plus the mirror for puts, so one pass
    of running sums over the strikes of a day replaces the strike-by-strike join.
    """
    up = Window.partitionBy(*keys).orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    x, c, p = C("strike"), C("call_oi"), C("put_oi")
    calls = x * F.sum(c).over(up) - F.sum(c * x).over(up)
    puts = (F.sum(p * x).over(whole) - F.sum(p * x).over(up)) - x * (F.sum(p).over(whole) - F.sum(p).over(up))
    return strikes.withColumn("_pain", calls + puts)


def max_pain_by_join(strikes: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """The same by joining every expiry price with every strike of the day."""
    at = strikes.select(*keys, C("strike").alias("x"))
    pay = (F.greatest(num(0), C("x") - C("strike")) * C("call_oi")
           + F.greatest(num(0), C("strike") - C("x")) * C("put_oi"))
    pain = at.join(strikes, keys).groupBy(*keys, "x").agg(F.sum(pay).alias("_pain"))
    return pain.groupBy(*keys).agg(F.min_by("x", F.struct("_pain", "x")).alias("max_pain"),
                                   F.min("_pain").alias("pain"))


def daily_summary(contracts: DataFrame) -> DataFrame:
    """(trade_date, symbol) -> pcr, atm_iv, max_pain, call_oi, put_oi for the nearest expiry.

    Contracts are read once and summed per strike; the nearest expiry, the pain of every strike
    and the sums of the day then share one partitioning by day and symbol.
    """
    first = F.min("expiry_date").over(Window.partitionBy(*DAY))
    strikes = with_pain(by_strike(contracts).withColumn("_first", first).filter("expiry_date = _first"))
    day = strikes.groupBy(*DAY).agg(F.sum("call_oi").alias("call_oi"), F.sum("put_oi").alias("put_oi"), busiest().alias("_a"),
                                    F.min_by("strike", F.struct("_pain", "strike")).alias("max_pain"))
    day = day.withColumns({"pcr": put_call(), "atm_strike": C("_a.strike"), "expiry_date": C("_a.expiry_date"), "atm_settle": C("_a.call_settle")})
    return atm_iv(day).select(*DAY, "pcr", "atm_iv", "max_pain", "call_oi", "put_oi")


def iv_rank(summary: DataFrame, window: int = 252, keep_all: bool = False) -> DataFrame:
    """Place of the volatility between its extremes of the current and `window` previous days with one.

    Days without a volatility are dropped, or kept with a null rank.
    """
    known = C("atm_iv") > 0
    df = summary if keep_all else summary.filter(known)
    w = Window.partitionBy("symbol", known).orderBy("trade_date").rowsBetween(-window, 0)
    lo, hi = F.min("atm_iv").over(w), F.max("atm_iv").over(w)
    return df.withColumn("iv_rank", F.when(known, F.when(hi > lo, (C("atm_iv") - lo) * 100 / (hi - lo)).otherwise(num(50))))


def series(summary: DataFrame, symbol: str, value: str, name: str | None = None) -> DataFrame:
    """(ts, value) of one symbol, for use as a market series."""
    return summary.filter(C("symbol") == symbol).select(C("trade_date").alias("ts"), C(value).alias(name or value))


def table_status(summary: DataFrame) -> DataFrame:
    return summary.agg(F.min("trade_date").alias("earliest"), F.max("trade_date").alias("latest"),
                       F.count_distinct("trade_date").alias("trading_days"))


def rounded_spot(spot: Column, step: float) -> Column:
    return F.bround(spot / step, 0) * step


def chain_window(chain: DataFrame, n: int = 10, keys: list[str] = DAY) -> DataFrame:
    """`n` strikes either side of the one nearest to `atm` (the lower of equals). Needs `strike`, `atm`."""
    w = Window.partitionBy(*keys).orderBy("strike")
    near = Window.partitionBy(*keys)
    out = chain.withColumns({"_i": F.row_number().over(w)})
    out = out.withColumn("_at", F.min_by("_i", F.struct(F.abs(C("strike") - C("atm")), "strike")).over(near))
    return out.filter(F.abs(C("_i") - C("_at")) <= n).drop("_i", "_at")


def oi_levels(strikes: DataFrame, n: int = 3, keys: list[str] = DAY) -> DataFrame:
    """Top strikes by put (support) and call (resistance) open interest, one row per rank."""
    def ranked(value, name):
        w = Window.partitionBy(*keys).orderBy(F.desc(value), "strike")
        return strikes.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= n).select(
            *keys, "rank", C("strike").alias(name))
    return ranked("put_oi", "support").join(ranked("call_oi", "resistance"), [*keys, "rank"])


def sentiment(df: DataFrame, value: str = "pcr") -> DataFrame:
    p = C(value)
    return df.withColumn("sentiment", ladder([
        (p > 1.3, "Strongly Bullish"), (p > 1.0, "Bullish"), (p < 0.7, "Strongly Bearish"), (p < 1.0, "Bearish")],
        "Neutral"))


def live_iv_rank(df: DataFrame, iv: str = "atm_iv") -> DataFrame:
    return df.withColumn("rough_iv_rank", F.round(clip((fill(C(iv), 15) - 10) / 40 * 100, 0, 100), 1))


# --- pricing. Columns: spot, strike, years, rate, sigma; calls where option_type = 'CE' ---


def _terms():
    s, k, t, r, v = C("spot"), C("strike"), C("years"), C("rate"), C("sigma")
    d1 = (F.ln(s / k) + (r + v * v * 0.5) * t) / (v * F.sqrt(t))
    return s, k, t, r, v, d1, d1 - v * F.sqrt(t), k * F.exp(-r * t)


def price(df: DataFrame) -> DataFrame:
    """Black-Scholes price; intrinsic value when time or volatility is not positive."""
    s, k, t, r, v, d1, d2, pv = _terms()
    live = (t > 0) & (v > 0)
    df = df.withColumns({"_d1": F.when(live, d1), "_d2": F.when(live, d2)})
    d1, d2 = C("_d1"), C("_d2")
    call = s * norm_cdf(d1) - pv * norm_cdf(d2)
    put = pv * norm_cdf(-d2) - s * norm_cdf(-d1)
    intrinsic = F.greatest(num(0), F.when(is_call(), s - k).otherwise(k - s))
    value = F.when(live, F.greatest(num(0), F.when(is_call(), call).otherwise(put))).otherwise(intrinsic)
    return df.withColumn("bs_price", value).drop("_d1", "_d2")


def greeks(df: DataFrame) -> DataFrame:
    """delta, gamma, theta per day, vega and rho per percent; zero without time or volatility."""
    s, k, t, r, v, d1, d2, pv = _terms()
    live = (t > 0) & (v > 0)
    df = df.withColumns({"_d1": F.when(live, d1), "_d2": F.when(live, d2)})
    d1, d2 = C("_d1"), C("_d2")
    drift = -(s * norm_pdf(d1) * v) / (F.sqrt(t) * 2)
    values = {
        "delta": (F.when(is_call(), norm_cdf(d1)).otherwise(norm_cdf(d1) - 1), 4),
        "gamma": (norm_pdf(d1) / (s * v * F.sqrt(t)), 6),
        "theta": (F.when(is_call(), drift - r * pv * norm_cdf(d2)).otherwise(drift + r * pv * norm_cdf(-d2)) / 365, 2),
        "vega": (s * norm_pdf(d1) * F.sqrt(t) / 100, 2),
        "rho": (F.when(is_call(), pv * t * norm_cdf(d2)).otherwise(-pv * t * norm_cdf(-d2)) / 100, 4),
    }
    return df.withColumns({n: F.when(live, F.round(e, d)).otherwise(num(0)) for n, (e, d) in values.items()}
                          ).drop("_d1", "_d2")


def implied_vol(df: DataFrame, steps: int = 60) -> DataFrame:
    """Volatility that gives `market_price`, by bisection on [1e-6, 10] in one column expression;
    0 when the price is not positive, below intrinsic value, or out of reach."""
    s, k, t, r, m = C("spot"), C("strike"), C("years"), C("rate"), C("market_price")
    pv = k * F.exp(-r * t)

    def value(v):
        d1 = (F.ln(s / k) + (r + v * v * 0.5) * t) / (v * F.sqrt(t))
        d2 = d1 - v * F.sqrt(t)
        call = s * norm_cdf(d1) - pv * norm_cdf(d2)
        return F.greatest(num(0), F.when(is_call(), call).otherwise(call - s + pv))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        below = value(mid) < m
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(num(1e-6).alias("lo"), num(10).alias("hi"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve,
                       lambda acc: (acc["lo"] + acc["hi"]) / 2)
    intrinsic = F.greatest(num(0), F.when(is_call(), s - k).otherwise(k - s))
    able = (m > 0) & (t > 0) & (m >= intrinsic) & (value(num(10)) >= m) & (value(num(1e-6)) <= m)
    return df.withColumn("iv", F.when(able, F.round(root, 4)).otherwise(num(0)))


def latest_readings(history: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """Last n readings per symbol; the rank limit is applied before the exchange."""
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return history.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= n)


def keep_readings(history: DataFrame, n: int = 1440, order: str = "ts") -> DataFrame:
    return latest_readings(history, n, order).drop("rank")


def pcr_trend(history: DataFrame, samples: int = 10, order: str = "ts") -> DataFrame:
    """Direction of the last readings of each symbol with at least two of them."""
    out = latest_readings(history, samples, order).groupBy("symbol").agg(
        F.max_by("pcr", order).alias("current"), F.min_by("pcr", order).alias("start"),
        F.count(F.lit(1)).alias("n_samples"),
        F.transform(F.array_sort(F.collect_list(F.struct(order, "pcr"))), lambda r: r["pcr"]).alias("pcrs"))
    out = out.filter("n_samples >= 2").withColumn("_s", (C("current") - C("start")) / C("n_samples"))
    return out.withColumns({
        "slope": F.round("_s", 4),
        "trend": ladder([(C("_s") > 0.02, "rising"), (C("_s") < -0.02, "falling")], "flat"),
        "signal": ladder([(C("_s") > 0.02, "Bearish"), (C("_s") < -0.02, "Bullish")], "Neutral")}).drop("_s")


def recommend(chain: DataFrame, signals: DataFrame, budget: float = 50000.0, keep: int = 3) -> DataFrame:
    """Best strikes for a signal among at-the-money and one or two steps out of the money.

    `chain`: keys, strike, option_type, ltp, delta, volume. `signals`: keys, signal, atm, step, lot_size.
    """
    sign = F.when(C("signal").contains("BUY"), num(1)).otherwise(num(-1))
    want = signals.withColumn("strike", F.explode(F.array(*[C("atm") + sign * C("step") * i for i in range(3)])))
    want = want.withColumn("option_type", F.when(C("signal").contains("BUY"), "CE").otherwise("PE"))
    out = chain.filter("ltp > 0").join(want, [*DAY, "strike", "option_type"])
    cost = C("ltp") * C("lot_size")
    out = out.withColumns({
        "per_lot": F.round(cost, 0),
        "max_lots": F.greatest(F.lit(1), F.floor(num(budget) / cost)),
        "score": F.abs(C("delta") - 0.5) * -10 + F.least(C("volume"), F.lit(10000)) / 1000})
    w = Window.partitionBy(*DAY).orderBy(F.desc("score"), "strike")
    return out.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= keep)
