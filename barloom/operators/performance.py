"""Equity curves, ratios, drawdowns, trade statistics, monthly returns and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import div, fill, num

C = F.col


def dates():
    """Ordered by date; only ever over one row per date."""
    return Window.orderBy("ts")


def equity_curve(flows: DataFrame, capital: float, marks: DataFrame | None = None) -> DataFrame:
    """Equity per date: capital, running cash flows and the day's open value.

    Flows are summed per date before the running total, so the ordered pass sees the
    calendar and not the trades.
    """
    daily = flows.groupBy("ts").agg(F.sum("cash").alias("cash"))
    if marks is not None:
        daily = daily.join(marks.groupBy("ts").agg(F.sum("value").alias("value")), "ts", "full")
    else:
        daily = daily.withColumn("value", num(0))
    run = F.sum(fill(C("cash"), 0)).over(dates().rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("ts", (run + capital + fill(C("value"), 0)).alias("equity"))


def drawdowns(equity: DataFrame) -> DataFrame:
    peak = F.max("equity").over(dates().rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("peak", peak).withColumn("drawdown", (C("equity") - C("peak")) / C("peak") * 100)


def summary(equity: DataFrame, capital: float) -> DataFrame:
    """Total return, CAGR, Sharpe, Sortino, Calmar and maximum drawdown, one row."""
    df = drawdowns(equity).withColumn("_r", div(C("equity"), F.lag("equity").over(dates())) - 1)
    out = df.agg(
        F.max_by("equity", "ts").alias("final"), F.min("ts").alias("_a"), F.max("ts").alias("_b"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        F.stddev_samp(F.when(C("_r") < 0, C("_r"))).alias("_ns"),
        F.abs(F.min("drawdown")).alias("max_drawdown_pct"),
        F.min_by(C("peak") - C("equity"), F.struct("drawdown", "ts")).alias("max_drawdown_money"))
    years = F.greatest(num(0.1), F.datediff("_b", "_a") / 365.25)
    out = out.withColumns({
        "total_return_pct": (C("final") / capital - 1) * 100,
        "cagr_pct": (F.pow(F.greatest(num(0), C("final") / capital), 1 / years) - 1) * 100,
        "sharpe": fill(F.when(C("_s") > 0, C("_m") / C("_s") * math.sqrt(252)), 0),
        "sortino": fill(F.when(C("_ns") > 0, C("_m") / C("_ns") * math.sqrt(252)), 0)})
    return out.withColumn("calmar", fill(div("cagr_pct", "max_drawdown_pct"), 0)).drop("_a", "_b", "_m", "_s", "_ns")


def trade_stats(trades: DataFrame, years: float = 1.0) -> DataFrame:
    """Win rate, mean win and loss, reward-risk, holding time, trades per month, costs; one row."""
    win = C("net_pnl") > 0
    n = F.count(F.lit(1))
    out = trades.agg(
        n.alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(~win).alias("losing_trades"),
        (F.count_if(win) / F.greatest(F.lit(1), n)).alias("win_rate"),
        fill(F.avg(F.when(win, C("pnl_pct"))), 0).alias("avg_win_pct"),
        fill(F.avg(F.when(~win, C("pnl_pct"))), 0).alias("avg_loss_pct"),
        F.avg("hold_days").alias("avg_hold_days"), (n / max(1.0, years * 12)).alias("trades_per_month"),
        F.sum("charges").alias("total_charges"), F.sum("slippage").alias("total_slippage"))
    return out.withColumn("reward_risk", fill(F.abs(div("avg_win_pct", "avg_loss_pct")), 0))


def trades_by_regime(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Trades, net result and wins by the market regime of their date; dates without one count as unknown."""
    out = trades.join(regimes.select("ts", "market_regime"), "ts", "left")
    return out.groupBy(F.coalesce("market_regime", F.lit("unknown")).alias("regime")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.count_if(C("net_pnl") > 0).alias("wins"))


def by_regime(trades: DataFrame, regime: str = "market_regime") -> DataFrame:
    return trades.groupBy(C(regime).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Change of the last equity of each calendar month; the first month has none."""
    last = equity.groupBy(F.last_day("ts").alias("month")).agg(F.max_by("equity", "ts").alias("_e"))
    w = Window.orderBy("month")
    out = last.withColumn("return_pct", (div(C("_e"), F.lag("_e").over(w)) - 1) * 100)
    return out.filter("return_pct is not null").select("month", "return_pct")


def trade_log(trades: DataFrame) -> DataFrame:
    money = [c for c in ("entry_price", "entry_raw", "slippage", "exit_price", "pnl_pct", "charges", "gross_pnl", "net_pnl")
             if c in trades.columns]
    return trades.withColumns({c: F.round(c, 2) for c in money}).orderBy("entry_ts", "symbol")


def buy_and_hold(bars: DataFrame, capital: float = 100000.0, least: int = 10) -> DataFrame:
    """Return, CAGR, Sharpe and drawdown of holding each symbol over its bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    df = bars.withColumns({
        "_r": div("close", F.lag("close").over(w)) - 1,
        "_peak": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("close", "ts").alias("_a"), F.max_by("close", "ts").alias("_b"),
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        F.abs(F.min((C("close") - C("_peak")) / C("_peak")) * 100).alias("max_drawdown_pct")
    ).filter(C("_n") >= least)
    growth = C("_b") / C("_a")
    years = F.greatest(num(0.1), F.datediff("_t1", "_t0") / 365.25)
    return out.select(
        "symbol", (growth * capital).alias("final_capital"), ((growth - 1) * 100).alias("total_return_pct"),
        ((F.pow(growth, 1 / years) - 1) * 100).alias("cagr_pct"),
        fill(F.when(C("_s") > 0, C("_m") / C("_s") * math.sqrt(252)), 0).alias("sharpe"), "max_drawdown_pct")


def alpha(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Strategy return and CAGR over those of the benchmark (one row against one or more)."""
    s = strategy.select(C("total_return_pct").alias("_r"), C("cagr_pct").alias("_c"))
    return benchmark.join(F.broadcast(s)).withColumns({  # one row
        "alpha_return": C("_r") - C("total_return_pct"), "alpha_cagr": C("_c") - C("cagr_pct")}).drop("_r", "_c")
