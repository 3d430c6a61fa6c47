"""Risk rules over a table of orders and fills of one account.

Counters come from fills (given), not from approvals. Running totals inside a day are built
from blocks of `fill_id`, so a day that holds a third of the table is spread over its
blocks: totals per (day, block) are aggregated and prefix-summed, and only rows of one
block are ordered together. Unique ids bound a block by its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import RiskConfig
from barloom.functions.cols import div, fill, ladder, num

C = F.col
CFG = RiskConfig()


def running_before(fills: DataFrame, sums: dict[str, str], width: int = 65536) -> DataFrame:
    """Per fill, totals of the earlier fills of its day (name -> column; '1' counts)."""
    rows = fills.withColumn("_b", F.floor(C("fill_id") / width))
    value = {n: F.lit(1) if c == "1" else C(c) for n, c in sums.items()}
    prior = Window.partitionBy("ts").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("ts", "_b").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in value.items()])
    blocks = blocks.select("ts", "_b", *[F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = Window.partitionBy("ts", "_b").orderBy("fill_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in value.items()})
    rows = rows.join(blocks, ["ts", "_b"])
    return rows.withColumns({n: C(f"_p_{n}") + C(f"_i_{n}") for n in sums}).select(*fills.columns, *sums)


def daily_state(fills: DataFrame, cfg: RiskConfig = CFG, sane_multiple: float | None = None) -> DataFrame:
    """Per date: counters of the day, and equity and peak carried across days.

    Equity and its peak run over one row per date. With `sane_multiple` stored figures are
    checked: a start-of-day equity outside (0, multiple] of the capital falls back to the
    capital, a peak below equity or above the multiple to the larger of the two.
    """
    cap = cfg.total_capital
    days = fills.groupBy("ts").agg(
        F.count(F.lit(1)).alias("trades_today"), F.sum("pnl").alias("pnl_today"),
        F.sum("trade_value").alias("capital_deployed"))
    w = Window.orderBy("ts")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("current_capital", F.sum("pnl_today").over(past) + cap)
    days = days.withColumn("_start", F.coalesce(F.lag("current_capital").over(w), num(cap)))
    days = days.withColumn("peak_capital", F.greatest(num(cap), F.max("current_capital").over(past)))
    days = days.withColumn("_speak", F.coalesce(F.lag("peak_capital").over(w), num(cap)))
    if sane_multiple is None:
        return days.withColumns({"start_capital": C("_start"), "start_peak": C("_speak")}).drop("_start", "_speak")
    most = cap * sane_multiple
    sane = F.when((C("_start") <= 0) | (C("_start") > most), num(cap)).otherwise(C("_start"))
    peak = F.when((C("_speak") < sane) | (C("_speak") > most), F.greatest(sane, num(cap))).otherwise(C("_speak"))
    return days.withColumns({"start_capital": sane, "start_peak": peak}).drop("_start", "_speak")


def week_start(state: DataFrame) -> DataFrame:
    """Capital at the start of the ISO week of each date."""
    week = [F.extract(F.lit("YEAROFWEEK"), "ts"), F.weekofyear("ts")]
    w = Window.partitionBy(*week).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return state.withColumn("week_start_capital", F.first("start_capital").over(w))


def status(state: DataFrame, cfg: RiskConfig = CFG) -> DataFrame:
    cap = cfg.total_capital
    return state.withColumns({
        "pnl_today_pct": C("pnl_today") / cap * 100, "daily_loss_limit": num(cap * cfg.max_daily_loss_pct),
        "capital_deployed_pct": C("capital_deployed") / cap * 100,
        "drawdown_pct": (C("peak_capital") - C("current_capital")) / F.greatest(num(1), C("peak_capital")) * 100})


def verdicts(orders: DataFrame, cfg: RiskConfig = CFG, width: int = 65536) -> DataFrame:
    """First failing rule of each order, or APPROVED, against what was filled before it.

    Optional columns: halted, at_time ('HH:mm'), is_option, iv, open_positions. Every fill
    counts as deployed for its whole day; `life_verdicts` lets positions close and halts last.
    """
    have = orders.columns
    df = running_before(orders, {"_pnl": "pnl", "_n": "1", "_used": "trade_value"}, width)
    days = week_start(daily_state(orders, cfg)).select("ts", "start_capital", "start_peak", "week_start_capital")
    df = df.join(days, "ts").withColumn("_now", C("start_capital") + C("_pnl"))
    df = df.withColumn("_peak", F.greatest("start_peak", "_now"))
    return df.withColumn("verdict", ladder([*entry_rules(have, cfg), *loss_rules(cfg), *size_rules(have, cfg)], "APPROVED")).select(*have, "verdict")


def is_option(have: list[str]) -> Column:
    return F.coalesce(C("is_option"), F.lit(False)) if "is_option" in have else F.lit(False)


def entry_rules(have: list[str], cfg: RiskConfig) -> list[tuple[Column, str]]:
    """Rules on halts, the clock and the signal. With the default hours all trading ends before that of options."""
    rules = []
    if "halted" in have:
        rules.append((F.coalesce(C("halted"), F.lit(False)), "HALTED"))
    if "at_time" in have:
        rules.append((C("at_time") >= cfg.no_new_trades_after, "CUTOFF_TIME"))
        rules.append((is_option(have) & (C("at_time") >= cfg.no_options_after), "OPTION_CUTOFF"))
    return [*rules, (C("ml_confidence") < cfg.min_ml_confidence, "LOW_CONFIDENCE"), (C("tech_score") < cfg.min_tech_score, "LOW_SCORE")]


def loss_rules(cfg: RiskConfig) -> list[tuple[Column, str]]:
    """Rules on losses, which halt trading. Need _pnl, _now, _peak, week_start_capital."""
    week, now, peak = C("week_start_capital"), C("_now"), C("_peak")
    return [(C("_pnl") < -cfg.total_capital * cfg.max_daily_loss_pct, "DAILY_LOSS"),
            ((week > 0) & (now > 0) & (div(week - now, week) > cfg.max_weekly_loss_pct), "WEEKLY_LOSS"),
            ((peak > 0) & (div(peak - now, peak) > cfg.max_drawdown_pct), "DRAWDOWN")]


def size_rules(have: list[str], cfg: RiskConfig) -> list[tuple[Column, str]]:
    """Rules on counts, sizes and volatility. Need _n, _used, trade_value."""
    cap, option = cfg.total_capital, is_option(have)
    rules = [(C("_n") >= cfg.max_trades_per_day, "TRADE_COUNT")]
    if "open_positions" in have:
        rules.append((C("open_positions") >= cfg.max_open_positions, "OPEN_POSITIONS"))
    limit = F.when(option, num(cap * cfg.max_single_option)).otherwise(num(cap * cfg.max_position_size))
    rules += [(C("trade_value") > limit, "POSITION_SIZE"), (C("_used") + C("trade_value") > cap * cfg.max_capital_deployed, "DEPLOYMENT")]
    if "iv" in have:
        rules.append((option & (C("iv") > cfg.max_iv_to_trade), "HIGH_IV"))
    return rules


# Events of one moment in the order in which they count.
CLOSE, LIFT, ORDER, OPEN = range(4)


def life_events(orders: DataFrame, positions: DataFrame, lifts: DataFrame | None = None) -> DataFrame:
    """One row per event: what it adds to the deployed value, open positions, trades and profit of its day.

    `orders`: order_id, at and columns of the rules; `positions`: position_id, opened_at,
    closed_at (null: still open), trade_value, pnl; `lifts`: at, when a halt was lifted.
    """
    def event(df: DataFrame, rank: int, at: str, key: Column, **adds: Column) -> DataFrame:
        zero = {"value": num(0), "held": F.lit(0), "trades": F.lit(0), "pnl": num(0)} | adds
        return df.filter(C(at).isNotNull()).select(F.to_date(at).alias("day"), C(at).alias("at"), F.lit(rank).alias("rank"), key.alias("id"),
                                                   *[v.alias(f"_{k}") for k, v in zero.items()], *[C(c) for c in df.columns if rank == ORDER and c not in ("at", "order_id")])

    out = event(orders, ORDER, "at", C("order_id"))
    opened = event(positions, OPEN, "opened_at", C("position_id"), value=C("trade_value"), held=F.lit(1), trades=F.lit(1))
    closed = event(positions, CLOSE, "closed_at", C("position_id"), value=-C("trade_value"), held=F.lit(-1), pnl=C("pnl"))
    out = out.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    if lifts is not None:
        out = out.unionByName(event(lifts, LIFT, "at", F.lit(0)), allowMissingColumns=True)
    return out


def swept(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """State after each event within its day: _n, _pnl, _high (best profit so far), _used, open_positions.

    What is deployed or open never falls below zero, so it is the running sum less its lowest
    point below zero. Sums and extremes run inside time buckets and over one row per bucket, so
    no task orders a whole day.
    """
    sums, low, high = ("_value", "_held", "_trades", "_pnl"), ("_value", "_held"), ("_pnl",)
    rows = events.withColumn("_b", F.date_trunc(bucket, "at"))
    inside = Window.partitionBy("day", "_b").orderBy("at", "rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s{c}": F.sum(c).over(inside) for c in sums})
    rows = rows.withColumns({**{f"_l{c}": F.min(f"_s{c}").over(inside) for c in low}, **{f"_h{c}": F.max(f"_s{c}").over(inside) for c in high}})
    ends = rows.groupBy("day", "_b").agg(*[F.sum(c).alias(f"_t{c}") for c in sums], *[F.min(f"_s{c}").alias(f"_m{c}") for c in low], *[F.max(f"_s{c}").alias(f"_x{c}") for c in high])
    prior = Window.partitionBy("day").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_o{c}": F.coalesce(F.sum(f"_t{c}").over(prior), F.lit(0)) for c in sums})
    ends = ends.withColumns({**{f"_ml{c}": F.coalesce(F.min(C(f"_o{c}") + C(f"_m{c}")).over(prior), F.lit(0)) for c in low},
                             **{f"_xh{c}": F.coalesce(F.max(C(f"_o{c}") + C(f"_x{c}")).over(prior), F.lit(0)) for c in high}})
    ends = ends.select("day", "_b", *[f"_o{c}" for c in sums], *[f"_ml{c}" for c in low], *[f"_xh{c}" for c in high])
    rows = rows.join(ends, ["day", "_b"])

    def total(c: str) -> Column:
        return C(f"_o{c}") + C(f"_s{c}")

    def floored(c: str) -> Column:
        return total(c) - F.least(F.lit(0), C(f"_ml{c}"), C(f"_o{c}") + C(f"_l{c}"))

    return rows.select(*events.columns, "_b", total("_trades").alias("_n"), total("_pnl").alias("_gain"), floored("_value").alias("_used"),
                       floored("_held").alias("open_positions"), F.greatest(F.lit(0), C("_xh_pnl"), C("_o_pnl") + C("_h_pnl")).alias("_high"))


def lasting(rows: DataFrame) -> DataFrame:
    """Add `halted`: whether a row of `_breach` came earlier on the day, and no lift since."""
    place = F.struct("at", "rank", "id")
    marks = {"_hit": F.when(C("_breach"), place), "_free": F.when(C("rank") == LIFT, place)}
    before = Window.partitionBy("day", "_b").orderBy("at", "rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    prior = Window.partitionBy("day").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("day", "_b").agg(*[F.max(c).alias(f"{n}_end") for n, c in marks.items()]).withColumns({f"{n}_past": F.max(f"{n}_end").over(prior) for n in marks})
    rows = rows.withColumns({n: F.max(c).over(before) for n, c in marks.items()}).join(ends.select("day", "_b", *[f"{n}_past" for n in marks]), ["day", "_b"])
    hit, free = F.coalesce("_hit", "_hit_past"), F.coalesce("_free", "_free_past")
    return rows.withColumn("halted", hit.isNotNull() & (free.isNull() | (hit > free)))


def life_verdicts(orders: DataFrame, positions: DataFrame, lifts: DataFrame | None = None, cfg: RiskConfig = CFG, bucket: str = "hour") -> DataFrame:
    """First failing rule of each order, or APPROVED, against positions that open and close.

    Opens and closes change what is deployed and open; counters start anew each day, equity and
    its peak do not. Trading halts when a close takes the day's profit below the daily limit,
    or when an order that passes the clock and the signal meets a loss rule; the halt lasts
    until it is lifted or the day ends. See `life_events` for the inputs.
    """
    cap, have = cfg.total_capital, [*orders.columns, "halted", "at_time", "open_positions"]
    rows = swept(life_events(orders, positions, lifts), bucket)
    w = Window.orderBy("day")  # one row per date
    days = rows.groupBy("day").agg(F.sum("_pnl").alias("_sum"), F.max("_high").alias("_most"))
    days = days.withColumn("start_capital", cap + F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), num(0)))
    days = days.withColumn("start_peak", F.greatest(num(cap), F.max(C("start_capital") + C("_most")).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    days = week_start(days.withColumnRenamed("day", "ts")).select(C("ts").alias("day"), "start_capital", "start_peak", "week_start_capital")
    rows = rows.drop("_pnl").withColumnRenamed("_gain", "_pnl").join(days, "day")
    rows = rows.withColumns({"_now": C("start_capital") + C("_pnl"), "_peak": F.greatest(C("start_peak"), C("start_capital") + C("_high")),
                             "at_time": F.date_format("at", "HH:mm")})
    signal = [*entry_rules([c for c in have if c != "halted"], cfg)]
    stopped = ladder([*[(c, F.lit(False)) for c, _ in signal], *[(c, F.lit(True)) for c, _ in loss_rules(cfg)]], F.lit(False))
    fallen = C("_pnl") < -cap * cfg.max_daily_loss_pct
    rows = lasting(rows.withColumn("_breach", F.when(C("rank") == ORDER, stopped).otherwise((C("rank") == CLOSE) & fallen)))
    verdict = ladder([*entry_rules(have, cfg), *loss_rules(cfg), *size_rules(have, cfg)], "APPROVED")
    return rows.filter(C("rank") == ORDER).withColumn("verdict", verdict).withColumnRenamed("id", "order_id").select(*orders.columns, "open_positions", "halted", "verdict")


def position_size(df: DataFrame, cfg: RiskConfig = CFG) -> DataFrame:
    """Quantity for 1 % risk, scaled by confidence and capped. Needs capital, entry, stop, atr, confidence, direction."""
    raw = C("entry") - C("stop")
    risk = F.when(C("direction") == "BUY", F.when(raw > 0, raw).otherwise(C("atr"))).otherwise(
        F.when(raw < 0, -raw).otherwise(C("atr")))
    share = F.greatest(C("entry") * 0.001, risk)
    qty = F.floor(C("capital") * 0.01 / share)
    qty = F.floor(qty * F.least(num(1.5), C("confidence") / 100 + 0.5))
    most = F.floor(C("capital") * cfg.max_position_size / F.greatest(C("entry"), num(0.01)))
    return df.withColumn("quantity", F.greatest(F.lit(1), F.least(qty, most)))


def half_kelly(stats: DataFrame, cfg: RiskConfig = CFG) -> DataFrame:
    """Half the Kelly fraction from win_rate, avg_win and avg_loss, capped by the position limit."""
    b, p = div("avg_win", "avg_loss"), C("win_rate")
    half = F.greatest(num(0), div(b * p - (1 - p), b) / 2)
    return stats.withColumn("kelly_fraction", F.when(C("avg_loss") == 0, num(0.01)).otherwise(
        F.round(F.least(fill(half, 0), num(cfg.max_position_size)), 4)))


def sector_exposure(fills: DataFrame, sectors: DataFrame, cfg: RiskConfig = CFG) -> DataFrame:
    """Value by sector as a share of capital, and whether it passes the cap."""
    out = fills.join(sectors, "symbol").groupBy("sector").agg(F.sum("trade_value").alias("exposure"))
    return out.withColumns({"share": C("exposure") / cfg.total_capital,
                            "over_cap": (C("exposure") / cfg.total_capital > cfg.max_sector_exposure).cast("int")})
