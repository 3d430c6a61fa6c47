"""Trade outcomes, costs, slippage, P&L, marks and portfolio summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import COST_PLANS, CostPlan, TradeConfig
from barloom.functions.cols import Series, div, fill, ladder, num

C = F.col
CFG = TradeConfig()

# Spread shares of very liquid symbols, and the default.
SPREADS = {"RELIANCE": 0.0005, "TCS": 0.0005, "HDFCBANK": 0.0005, "NIFTY": 0.0002, "BANKNIFTY": 0.0002}
DEFAULT_SPREAD = 0.001
FILL_SLIP = 0.0005


def next_bar(df: DataFrame) -> DataFrame:
    """Date and open of the following bar."""
    s = Series(df)
    return df.withColumns({"next_ts": s.lead("ts"), "next_open": s.lead("open")})


def regime_levels(df: DataFrame, regime: str = "market_regime") -> DataFrame:
    """Size multiplier and stop and target multiples of ATR by market regime."""
    r = C(regime)
    crisis, calm = r == "high_vol_crisis", r == "mean_reverting"
    return df.withColumns({
        "size_mult": ladder([(crisis, num(0.5)), (r == "trending", num(1.2))], num(1)),
        "sl_mult": ladder([(calm, num(1)), (crisis, num(2))], num(1.5)),
        "tp_mult": ladder([(calm, num(2))], num(3))})


def outcomes(signals: DataFrame, cfg: TradeConfig = CFG) -> DataFrame:
    """Outcome of each signal on its own: entry at the next open, then the first exit.

    `signals` is a whole panel with `is_signal`, atr, tech_score, stop_loss and take_profit; bars
    of one symbol are daily, so an exit by time lies within max_days + 1 rows and the frame
    that is folded is bounded; two bars of one day raise an error. Order within a bar: stop,
    trailing stop, target, score, time.
    """
    s = Series(signals)
    rows = cfg.max_days + 1
    bar = F.struct("ts", "open", "high", "low", "close", C("atr"), C("tech_score").alias("score"))
    twice = F.to_date(s.lag("ts")) == F.to_date("ts")
    checked = F.when(twice, F.raise_error(F.lit("trade outcomes need one bar per symbol and day")).cast("boolean")).otherwise(C("is_signal"))
    df = signals.withColumn("is_signal", checked).withColumns({
        "_bars": F.collect_list(bar).over(s.rows(1, rows)),
        "_last": F.last(F.struct("ts", "close")).over(s.rows(0, rows))})
    df = df.filter(C("is_signal") & (F.size("_bars") > 0))
    first = F.get("_bars", F.lit(0))
    df = df.withColumns({"entry_ts": first["ts"], "entry_raw": first["open"],
                         "entry_price": first["open"] + C("atr") * cfg.entry_slip})
    if cfg.levels == "regime":
        df = regime_levels(df)
        stop, target = C("entry_price") - C("sl_mult") * C("atr"), C("entry_price") + C("tp_mult") * C("atr")
    else:
        stop, target = C("stop_loss"), C("take_profit")
    df = df.withColumns({"_sl": stop, "_tp": target}).filter("entry_price > 0")
    entry, sl, tp = C("entry_price"), C("_sl"), C("_tp")

    def outcome(b, trail):
        slip = b["atr"] * cfg.exit_slip
        reason = (F.when(b["low"] <= sl, "SL").when((trail > entry) & (b["low"] <= trail), "TRAIL_STOP")
                  .when(b["high"] >= tp, "TP").when(b["score"] < cfg.reversal_score, "SIGNAL_REV")
                  .when(F.datediff(b["ts"], C("entry_ts")) >= cfg.max_days, "TIME_EXIT"))
        at = (F.when(b["low"] <= sl, sl - slip).when((trail > entry) & (b["low"] <= trail), trail)
              .when(b["high"] >= tp, tp - slip).otherwise(b["close"]))
        return reason, F.greatest(num(0.01), at)

    def step(acc, b):
        raised = F.when(b["close"] > entry + b["atr"], F.greatest(acc["trail"], b["close"] - b["atr"])
                        ).otherwise(acc["trail"])
        reason, at = outcome(b, acc["trail"] if cfg.trail_lag else raised)
        done = acc["reason"].isNotNull()
        now = F.struct(raised.alias("trail"), reason.alias("reason"), b["ts"].alias("ts"), at.alias("price"))
        return F.when(done, acc).otherwise(now)

    start = F.struct(sl.alias("trail"), F.lit(None).cast("string").alias("reason"),
                     C("entry_ts").alias("ts"), entry.alias("price"))
    df = df.withColumn("_x", F.aggregate("_bars", start, step))
    open_end = C("_x.reason").isNull()
    df = df.withColumns({
        "exit_reason": F.coalesce("_x.reason", F.lit("EOD_FORCE")),
        "exit_ts": F.when(open_end, C("_last.ts")).otherwise(C("_x.ts")),
        "exit_price": F.when(open_end, C("_last.close")).otherwise(C("_x.price"))})
    df = df.withColumns({"pnl_pct": (C("exit_price") / entry - 1) * 100,
                         "hold_days": F.datediff("exit_ts", "entry_ts")})
    return df.drop("_bars", "_last", "_sl", "_tp", "_x")


def charge_parts(value: Column, side: Column, plan: CostPlan) -> dict[str, Column]:
    """Components of the charges on one leg."""
    buy = side == "BUY"
    brokerage = F.greatest(num(plan.flat), value * plan.pct)
    tax = F.when(buy, num(0)).otherwise(value * plan.sell_tax)
    regulator = value * plan.regulator
    if not plan.regulator_buy:
        regulator = F.when(buy, num(0)).otherwise(regulator)
    exchange = value * plan.exchange
    stamp = F.when(buy, value * plan.stamp_buy).otherwise(num(0))
    base = brokerage + exchange + (regulator if plan.levy_on_regulator else num(0))
    return {"brokerage": brokerage, "sell_tax": tax, "regulator": regulator, "exchange": exchange,
            "stamp": stamp, "levy": base * plan.levy}


def charges(value: Column, side: Column, plan: str = "delivery") -> Column:
    return sum(charge_parts(value, side, COST_PLANS[plan]).values(), num(0))


def costs(trades: DataFrame, plan: str = "delivery") -> DataFrame:
    """Charges of one leg as a struct of parts and their total. Needs value, side."""
    parts = charge_parts(C("value"), C("side"), COST_PLANS[plan])
    return trades.withColumns({"charge_parts": F.struct(*[v.alias(k) for k, v in parts.items()]),
                               "charges": sum(parts.values(), num(0))})


def half_spread(symbol: Column) -> Column:
    return ladder([(symbol == k, num(v)) for k, v in SPREADS.items()], num(DEFAULT_SPREAD)) / 2


def fill_prices(quotes: DataFrame) -> DataFrame:
    """Buy and sell fills around `price`: half the spread, or a flat slip."""
    p = C("price")
    return quotes.withColumns({
        "buy_fill": p * (1 + half_spread(C("symbol"))), "sell_fill": p * (1 - half_spread(C("symbol"))),
        "buy_slip": p * (1 + FILL_SLIP), "sell_slip": p * (1 - FILL_SLIP)})


def pnl(trades: DataFrame, plan: str = "delivery") -> DataFrame:
    """Gross, charges of both legs, net and percent, by direction. Needs direction, quantity and prices."""
    sign = F.when(C("direction") == "LONG", num(1)).otherwise(num(-1))
    long = C("direction") == "LONG"
    entry, exit_ = C("entry_price") * C("quantity"), C("exit_price") * C("quantity")
    first, second = F.when(long, "BUY").otherwise("SELL"), F.when(long, "SELL").otherwise("BUY")
    out = trades.withColumns({
        "gross_pnl": sign * (C("exit_price") - C("entry_price")) * C("quantity"),
        "charges": charges(entry, first, plan) + charges(exit_, second, plan),
        "pnl_pct": sign * (C("exit_price") / C("entry_price") - 1) * 100})
    return out.withColumn("net_pnl", C("gross_pnl") - C("charges"))


def not_held(candidates: DataFrame, held: DataFrame) -> DataFrame:
    return candidates.join(held, "symbol", "left_anti")


def extremes_after(positions: DataFrame, quotes: DataFrame, bucket: str = "hour") -> DataFrame:
    """Highest and lowest quote from entry_ts on, null without one. No position meets a quote.

    Both sides are ordered together inside (symbol, bucket), newest first, so a running extreme
    gives each position what follows in its own bucket; later buckets come from a suffix over
    one row per bucket.
    """
    keys, part = positions.columns, F.date_trunc(bucket, C("_t")).alias("_b")
    none = F.lit(None).cast("double")
    held = positions.withColumn("_t", C("entry_ts"))
    both = quotes.select("symbol", C("ts").alias("_t"), C("price").alias("_p"), F.lit(0).alias("_side")).unionByName(
        held.withColumns({"_p": none, "_side": F.lit(1)}), allowMissingColumns=True).select("*", part)
    newest = Window.partitionBy("symbol", "_b").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({"_h": F.max("_p").over(newest), "_l": F.min("_p").over(newest)}).filter("_side = 1")
    later = Window.partitionBy("symbol").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("symbol", "_b").agg(F.max("_p").alias("_bh"), F.min("_p").alias("_bl"))
    ends = ends.select("symbol", "_b", F.max("_bh").over(later).alias("_ah"), F.min("_bl").over(later).alias("_al"))
    same = (inside["symbol"] == ends["symbol"]) & inside["_b"].eqNullSafe(ends["_b"])
    out = inside.join(ends, same, "left")
    known = inside["entry_ts"].isNotNull()
    return out.select(*[inside[c] for c in keys], F.when(known, F.greatest("_h", "_ah")).alias("highest"), F.when(known, F.least("_l", "_al")).alias("lowest"))


def mark(positions: DataFrame, quotes: DataFrame, atr_share: float = 0.015) -> DataFrame:
    """Value open positions at the last quote and name the exit their levels call for.

    The running extreme since entry is an aggregate over quotes, not state (see `extremes_after`).
    Positions: symbol, direction, quantity, entry_price, entry_ts, stop_loss, take_profit, and
    any column that tells two of one symbol apart.
    """
    keys = positions.columns
    seen = extremes_after(positions, quotes).groupBy(*keys).agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))
    last = quotes.groupBy("symbol").agg(F.max(F.struct("ts", "event_id", "price")).alias("_q")).select("symbol", C("_q.price").alias("price"))
    seen = seen.join(last, "symbol", "left").select(*keys, "price", "highest", "lowest")
    long, p = C("direction") == "LONG", C("price")
    sign = F.when(long, num(1)).otherwise(num(-1))
    high, low = F.greatest("highest", "entry_price"), F.least("lowest", "entry_price")
    trail = F.when(long, F.when(high > C("entry_price"), F.greatest(C("stop_loss"), high * (1 - atr_share)))
                   .otherwise(C("stop_loss"))).otherwise(
        F.when(low < C("entry_price"), F.least(C("stop_loss"), low * (1 + atr_share))).otherwise(C("stop_loss")))
    out = seen.withColumns({
        "market_value": C("quantity") * p,
        "unrealised_pnl": sign * (p - C("entry_price")) * C("quantity"),
        "unrealised_pct": sign * (p / C("entry_price") - 1) * 100, "trailing_stop": trail})
    t, e = C("trailing_stop"), C("entry_price")
    flag_ = ladder([
        (p.isNull(), F.lit(None).cast("string")),
        (F.when(long, p <= C("stop_loss")).otherwise(p >= C("stop_loss")), "SL_HIT"),
        (F.when(long, p >= C("take_profit")).otherwise(p <= C("take_profit")), "TP_HIT"),
        (F.when(long, (t > e) & (p <= t)).otherwise((t < e) & (p >= t)), "TRAIL_STOP")],
        F.lit(None).cast("string"))
    return out.withColumn("exit_flag", flag_).drop("highest", "lowest")


def portfolio(marked: DataFrame, closed: DataFrame) -> DataFrame:
    """One-row summary of open and closed positions."""
    open_ = marked.agg(F.count(F.lit(1)).alias("open_positions"),
                       fill(F.sum("market_value"), 0).alias("market_value"),
                       fill(F.sum("unrealised_pnl"), 0).alias("unrealised_pnl"))
    done = closed.agg(F.count(F.lit(1)).alias("total_trades"), fill(F.sum("net_pnl"), 0).alias("realised_pnl"),
                      fill(F.sum("gross_pnl"), 0).alias("gross_pnl"), fill(F.sum("charges"), 0).alias("charges_paid"),
                      (F.count_if(C("net_pnl") > 0) * 100 / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("win_rate"))
    out = open_.join(F.broadcast(done))  # one row each
    return out.withColumn("total_pnl", C("unrealised_pnl") + C("realised_pnl"))


def daily_report(closed: DataFrame, day: str = "ts") -> DataFrame:
    """Trades closed and their net result per day."""
    return closed.groupBy(C(day).alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("day_pnl"),
        F.count_if(C("net_pnl") > 0).alias("wins"))
