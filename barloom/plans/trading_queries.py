"""Scoring, ranking, trade, performance, risk and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import COST_PLANS, RiskConfig
from barloom.operators import datasets, features as fe, indicators as ind, labels, models, performance, risk, scoring, trades
from barloom.plans import sql_base as q
from barloom.plans.feature_queries import market
from barloom.plans.registry import near as near_to
from barloom.plans.registry import query, tidy
from barloom.plans.sql_base import rnd
from barloom.session import cut
from barloom.sources import tables

C = F.col
SCORED_SQL = q.with_(q.BARS, q.IND, q.SCORE)
SCORE_FAMILIES = [ind.RSI, ind.MACD, ind.BOLLINGER, ind.VOLUME_RATIO, ind.FIBONACCI, ind.EMA, ind.ATR]


def scored(spark, sf_dir):
    return scoring.tech_score(ind.run(tables.bars(spark, sf_dir), SCORE_FAMILIES, ind.CFG))


@query("top_ranked", q.with_(q.BARS) + f"""SELECT symbol, ts, {rnd(['close', 'm20', 'band', 'vr', 'close / m20 - 1 AS strength'])} FROM (SELECT *, {q.roll('avg', 'close', 20)} AS m20,
 4 * {q.frame('stddev_pop(close)', -19, 0)} AS band, volume / {q.roll('avg', 'volume', 20)} AS vr FROM bars)
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 ORDER BY close / m20 DESC, symbol LIMIT 10""")
def top_ranked(spark, sf_dir):
    """Latest bar of every symbol ranked by its distance from the 20-bar mean: the top 10."""
    out = ind.run(tables.bars(spark, sf_dir), [ind.BOLLINGER, ind.VOLUME_RATIO], ind.CFG)
    last = scoring.latest(out.select("symbol", "ts", "close", C("bb_mid").alias("m20"),
                                     (C("bb_upper") - C("bb_lower")).alias("band"), C("vol_ratio").alias("vr")))
    last = last.withColumn("strength", C("close") / C("m20") - 1)
    return tidy(last.orderBy(F.desc("strength"), "symbol").limit(10))


@query("technical_score", SCORED_SQL + f"""SELECT symbol, ts, {rnd(['score'])}, signal, CAST(confirmations AS INTEGER) AS confirmations,
 CAST(bear_confirmations AS INTEGER) AS bear_confirmations, {rnd(['stop_loss', 'take_profit'], 2)} FROM scored""")
def technical_score(spark, sf_dir):
    out = scored(spark, sf_dir)
    return out.select("symbol", "ts", near_to(C("score"), 4).alias("score"), "signal", "confirmations", "bear_confirmations",
                      *[near_to(C(c), 2).alias(c) for c in ("stop_loss", "take_profit")])


@query("score_breakdown", SCORED_SQL + f"""SELECT symbol, ts, {rnd(['round(p_rsi * 0.25 * 100, 1) AS rsi_part', 'round(p_macd * 0.2 * 100, 1) AS macd_part', 'round(p_bb * 0.15 * 100, 1) AS bb_part',
 'round(p_vol * 0.15 * 100, 1) AS volume_part', 'round(fib_score * 0.1 * 100, 1) AS fib_part', 'round(p_ema * 0.15 * 100, 1) AS ema_part'], 1)} FROM scored""")
def score_breakdown(spark, sf_dir):
    out = scored(spark, sf_dir)
    parts = {"rsi": "rsi_part", "macd": "macd_part", "bb": "bb_part", "volume": "volume_part", "fibonacci": "fib_part", "ema_trend": "ema_part"}
    return tidy(out.select("symbol", "ts", *[C(f"breakdown.{k}").alias(v) for k, v in parts.items()]), digits=1)


@query("signal_counts", SCORED_SQL + "SELECT signal, count(*) AS n FROM scored GROUP BY 1")
def signal_counts(spark, sf_dir):
    return scoring.signal_counts(scored(spark, sf_dir))


@query("scan_counts", SCORED_SQL + """SELECT ts, count(*) FILTER (signal LIKE '%BUY') AS buys, count(*) FILTER (signal LIKE '%SELL') AS sells,
 count(*) FILTER (signal = 'HOLD') AS holds FROM scored GROUP BY 1""")
def scan_counts(spark, sf_dir):
    return scoring.scan_counts(scored(spark, sf_dir))


@query("signal_report", SCORED_SQL + f"SELECT symbol, ts, {rnd(['tech_score'])}, signal FROM scored ORDER BY tech_score DESC, symbol, ts LIMIT 8")
def signal_report(spark, sf_dir):
    return tidy(scoring.signal_report(scored(spark, sf_dir)), ["symbol", "ts", "tech_score", "signal"])


NEWS_SCORE = "ns AS (SELECT p_brand AS symbol, CAST(avg(p_size) + 25 AS DOUBLE) AS news_score FROM part GROUP BY 1)"


def news_scores(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").groupBy(C("p_brand").alias("symbol")).agg((F.avg("p_size") + 25).alias("news_score"))


@query("universe_scan", q.with_(q.BARS, q.IND, q.SCORE, NEWS_SCORE) + f"""SELECT symbol, ts, {rnd(['tech_score', 'combined_score'], 1)}, signal FROM (SELECT s.*,
 round(tech_score * 0.8 + coalesce(news_score, 50) * 0.2, 1) AS combined_score FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1
 AND count(*) OVER (PARTITION BY symbol) >= 50) s LEFT JOIN ns USING (symbol)) ORDER BY combined_score DESC, symbol LIMIT 10""")
def universe_scan(spark, sf_dir):
    out = scored(spark, sf_dir).select("symbol", "ts", "close", "tech_score", "signal")
    return tidy(scoring.scan(out, news_scores(spark, sf_dir)), ["symbol", "ts", "tech_score", "combined_score", "signal"], 1)


# Probabilities as a plain function of the row, to check what is built on model scores.
PROB_SQL = "CAST(date_part('doy', ts) * 37 % 101 AS DOUBLE) / 100"


def prob():
    return (F.dayofyear("ts") * 37 % 101).cast("double") / 100


@query("model_signal", q.with_(q.BARS) + f"""SELECT model_signal, count(*) AS n, {rnd(['sum(kelly) AS kelly_sum', 'sum(er) AS return_sum'], 2)} FROM (SELECT CASE WHEN p >= 0.68 THEN 'STRONG BUY' WHEN p >= 0.55 THEN 'BUY'
 WHEN p <= 0.32 THEN 'STRONG SELL' WHEN p <= 0.45 THEN 'SELL' ELSE 'HOLD' END AS model_signal, least(greatest((p - 0.5) / greatest(0.01, 1 - p) * 0.5, 0), 0.25) AS kelly,
 p * 2 * 0.015 * sqrt(5) AS er FROM (SELECT {PROB_SQL} AS p FROM bars)) GROUP BY 1""")
def model_signal(spark, sf_dir):
    df = tables.bars(spark, sf_dir).select(prob().alias("prob")).withColumns({"sharpe": C("prob") * 2, "vol": F.lit(0.015)})
    out = scoring.kelly(scoring.model_signal(df))
    return tidy(out.groupBy("model_signal").agg(F.count(F.lit(1)).alias("n"), F.sum("kelly_fraction").alias("kelly_sum"),
                                                F.sum("expected_return").alias("return_sum")), digits=2)


REG = q.with_(q.BARS, q.VIX, q.IND)


@query("ensemble_regime", REG + """SELECT regime, w_boost, w_forest, w_sequence, count(*) AS n FROM (SELECT *, CASE regime WHEN 'trending' THEN CAST(0.55 AS DOUBLE) WHEN 'trending_vol' THEN 0.4 WHEN 'mean_reverting' THEN 0.25 ELSE 0.33 END AS w_boost,
 CASE regime WHEN 'trending' THEN CAST(0.2 AS DOUBLE) WHEN 'trending_vol' THEN 0.25 WHEN 'mean_reverting' THEN 0.5 ELSE 0.34 END AS w_forest,
 CASE regime WHEN 'trending' THEN CAST(0.25 AS DOUBLE) WHEN 'trending_vol' THEN 0.35 WHEN 'mean_reverting' THEN 0.25 ELSE 0.33 END AS w_sequence FROM
 (SELECT CASE WHEN adx > 25 AND vix <= 20 THEN 'trending' WHEN adx > 25 THEN 'trending_vol' WHEN vix <= 20 THEN 'mean_reverting' ELSE 'high_vol_chop' END AS regime FROM ind JOIN vix USING (ts))) GROUP BY 1, 2, 3, 4""")
def ensemble_regime(spark, sf_dir):
    df = ind.adx(tables.bars(spark, sf_dir)).join(tables.vix(spark, sf_dir), "ts")
    return scoring.regime(df).groupBy("regime", "w_boost", "w_forest", "w_sequence").agg(F.count(F.lit(1)).alias("n"))


DAILY = """dreg AS (SELECT ts, coalesce(vix, 15) AS vix, coalesce(a, 20) AS mean_adx, CASE WHEN coalesce(vix, 15) > 25 THEN 'high_vol_crisis' WHEN coalesce(a, 20) > 25 AND coalesce(vix, 15) < 20 THEN 'trending'
 WHEN coalesce(a, 20) < 20 THEN 'mean_reverting' ELSE 'normal' END AS market_regime FROM (SELECT DISTINCT ts FROM ind) LEFT JOIN (SELECT ts, avg(adx) AS a FROM ind GROUP BY 1) USING (ts) LEFT JOIN vix USING (ts))"""


@query("daily_regime", q.with_(q.BARS, q.VIX, q.IND, DAILY) + f"SELECT ts, {rnd(['vix', 'mean_adx'])}, market_regime FROM dreg")
def daily_regime(spark, sf_dir):
    return tidy(scoring.daily_regime(ind.adx(tables.bars(spark, sf_dir)), tables.vix(spark, sf_dir)))


@query("regime_counts", q.with_(q.BARS, q.VIX, q.IND, DAILY) + "SELECT market_regime AS regime, count(*) AS n FROM dreg GROUP BY 1")
def regime_counts(spark, sf_dir):
    return performance.by_regime(scoring.daily_regime(ind.adx(tables.bars(spark, sf_dir)), tables.vix(spark, sf_dir)))


CANDIDATES = f"""cand AS (SELECT symbol, ts, tech_score, {PROB_SQL} AS prob, tech_score * 0.6 + {PROB_SQL} * 40 AS rank_score FROM scored JOIN dreg USING (ts)
 WHERE tech_score >= CASE WHEN market_regime = 'high_vol_crisis' THEN 66.00000000000001 ELSE 60 END AND {PROB_SQL} >= 0.55),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY rank_score DESC, symbol) AS INTEGER) AS rank FROM cand QUALIFY rank <= 3)"""


@query("daily_candidates", q.with_(q.BARS, q.VIX, q.IND, q.SCORE, DAILY, CANDIDATES) + f"SELECT symbol, ts, {rnd(['rank_score'])}, rank FROM best")
def daily_candidates(spark, sf_dir):
    full = scoring.tech_score(ind.run(tables.bars(spark, sf_dir), [*SCORE_FAMILIES, ind.ADX], ind.CFG)).withColumn("prob", prob())
    reg = scoring.daily_regime(full, tables.vix(spark, sf_dir))
    return tidy(scoring.daily_candidates(full, reg, 3), ["symbol", "ts", "rank_score", "rank"])


@query("ensemble_blend", q.with_(q.BARS) + f"""SELECT symbol, ts, {rnd(["CASE WHEN s IS NULL THEN t ELSE t * 0.75 + s * 0.25 END AS prob"])} FROM (SELECT symbol, ts,
 CASE WHEN volume > 30 THEN (p * 0.5 + (1 - p) * 0.3) / 0.8 ELSE p END AS t, CASE WHEN volume > 60 THEN p * p END AS s FROM (SELECT *, {PROB_SQL} AS p FROM bars))""")
def ensemble_blend(spark, sf_dir):
    df = tables.bars(spark, sf_dir).withColumns({
        "a": prob(), "b": F.when(C("volume") > 30, 1 - prob()), "seq_prob": F.when(C("volume") > 60, prob() * prob()),
        "wa": F.lit(0.5), "wb": F.lit(0.3), "w_sequence": F.lit(0.25)})
    return tidy(scoring.blend(df, {"a": "a", "b": "b"}, {"a": "wa", "b": "wb"}), ["symbol", "ts", "prob"])


@query("sequence_scores", q.with_(q.BARS) + f"SELECT symbol, ts, {rnd(['CASE WHEN volume > 60 THEN p ELSE 0.5 END AS seq_prob'])}, CAST(volume > 60 AS INTEGER) AS matched FROM (SELECT *, {PROB_SQL} AS p FROM bars)")
def sequence_scores(spark, sf_dir):
    b = tables.bars(spark, sf_dir)
    seq = b.filter("volume > 60").select("symbol", "ts", prob().alias("seq_prob"))
    return tidy(models.with_sequence_scores(b.select("symbol", "ts"), seq))


@query("signal_gate", SCORED_SQL + f"SELECT symbol, ts, signal, {rnd(['least(CAST(0.10 AS DOUBLE), p * 0.2) AS size'])} FROM (SELECT *, {PROB_SQL} AS p FROM scored) WHERE signal LIKE 'STRONG%' AND p * 100 >= 70")
def signal_gate(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"confidence": prob() * 100, "kelly_fraction": prob() * 0.4})
    return tidy(scoring.gate(df, 0.5), ["symbol", "ts", "signal", "size"])


# --- trades -----------------------------------------------------------------------------

# Signals are rows with a score of 60 or more; a trade row is one of them with its first exit.
OUTCOME = """sig AS (SELECT symbol, rn, ts, atr, stop_loss AS sl, take_profit AS tp FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS r FROM ind) ) ,
tb AS MATERIALIZED (SELECT s.symbol, s.ts, s.rn, s.open, s.high, s.low, s.close, s.atr, s.tech_score, i.stop_loss AS sl, i.take_profit AS tp FROM scored s JOIN ind i ON i.symbol = s.symbol AND i.rn = s.rn),
en AS (SELECT a.symbol, a.ts, a.rn, a.sl, a.tp, b.ts AS entry_ts, b.open + 0.05 * a.atr AS entry_price FROM tb a JOIN tb b ON b.symbol = a.symbol AND b.rn = a.rn + 1
 WHERE a.tech_score >= 60 AND b.open + 0.05 * a.atr > 0),
wk AS (SELECT e.*, b.rn AS brn, b.ts AS bts, b.high, b.low, b.close, b.atr, b.tech_score AS score, greatest(e.sl, coalesce(max(CASE WHEN b.close > e.entry_price + b.atr THEN b.close - b.atr END)
 OVER (PARTITION BY e.symbol, e.rn ORDER BY b.rn ROWS UNBOUNDED PRECEDING), e.sl)) AS trail FROM en e CROSS JOIN range(1, 22) o(k) JOIN tb b ON b.symbol = e.symbol AND b.rn = e.rn + o.k),
rs AS (SELECT *, CASE WHEN low <= sl THEN 'SL' WHEN trail > entry_price AND low <= trail THEN 'TRAIL_STOP' WHEN high >= tp THEN 'TP' WHEN score < 35 THEN 'SIGNAL_REV'
 WHEN date_diff('day', entry_ts, bts) >= 20 THEN 'TIME_EXIT' END AS reason FROM wk),
fx AS (SELECT symbol, ts, min(CASE WHEN reason IS NOT NULL THEN brn END) AS x, max(brn) AS z FROM rs GROUP BY 1, 2),
outc AS MATERIALIZED (SELECT rs.symbol, rs.ts, entry_ts, entry_price, coalesce(reason, 'EOD_FORCE') AS exit_reason, bts AS exit_ts,
 CASE WHEN reason IS NULL THEN close ELSE greatest(0.01, CASE reason WHEN 'SL' THEN sl - 0.03 * atr WHEN 'TRAIL_STOP' THEN trail WHEN 'TP' THEN tp - 0.03 * atr ELSE close END) END AS exit_price
 FROM rs JOIN fx ON fx.symbol = rs.symbol AND fx.ts = rs.ts AND rs.brn = coalesce(x, z))"""
OUTCOME = OUTCOME[OUTCOME.index("tb AS"):]


def outcomes(spark, sf_dir):
    bars = ind.run(tables.bars(spark, sf_dir), SCORE_FAMILIES, ind.CFG)
    exact = scoring.tech_score(bars.withColumns({"_sl": C("stop_loss"), "_tp": C("take_profit")}))
    exact = exact.withColumns({"stop_loss": C("_sl"), "take_profit": C("_tp"), "is_signal": C("tech_score") >= 60})
    return trades.outcomes(exact.drop("breakdown"))


@query("trade_outcomes", q.with_(q.BARS, q.IND, q.SCORE, OUTCOME) + f"""SELECT symbol, ts, entry_ts, exit_ts, exit_reason, {rnd(['entry_price', 'exit_price'], 3)},
 CAST(date_diff('day', entry_ts, exit_ts) AS INTEGER) AS hold_days FROM outc""")
def trade_outcomes(spark, sf_dir):
    return tidy(outcomes(spark, sf_dir), ["symbol", "ts", "entry_ts", "exit_ts", "exit_reason", "entry_price", "exit_price", "hold_days"], 3)


def closed_trades(spark, sf_dir):
    """Fills as closed trades: long by turns with short, priced from the order value."""
    f = tables.fills(spark, sf_dir)
    return f.withColumns({
        "direction": F.when(C("fill_id") % 2 == 0, "LONG").otherwise("SHORT"), "quantity": 10 + C("fill_id") % 7,
        "entry_price": C("trade_value") / 100, "exit_price": C("trade_value") / 100 * (1 + (C("fill_id") % 13 - 6) / 100.0),
        "hold_days": (C("fill_id") % 20).cast("int"), "slippage": C("trade_value") * 0.0001, "entry_ts": C("ts")})


CLOSED = """ct AS (SELECT *, CASE WHEN fill_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, 10 + fill_id % 7 AS quantity, trade_value / 100 AS entry_price,
 trade_value / 100 * (1 + (fill_id % 13 - 6) / CAST(100 AS DOUBLE)) AS exit_price, fill_id % 20 AS hold_days, trade_value * 0.0001 AS slippage FROM fills),
c1 AS (SELECT *, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS sg, CASE WHEN direction = 'LONG' THEN entry_price ELSE exit_price END * quantity AS bv,
 CASE WHEN direction = 'LONG' THEN exit_price ELSE entry_price END * quantity AS sv FROM ct),
closed AS (SELECT *, sg * (exit_price - entry_price) * quantity AS gross_pnl, (exit_price / entry_price - 1) * 100 * sg AS pnl_pct,
 (bv + sv) * (0.000001 + 0.0000325) * 1.18 + bv * 0.00015 + sv * 0.001 AS charges,
 sg * (exit_price - entry_price) * quantity - ((bv + sv) * (0.000001 + 0.0000325) * 1.18 + bv * 0.00015 + sv * 0.001) AS net_pnl FROM c1)"""
TRADE_SQL = q.with_(q.FILLS, CLOSED)


def priced_trades(spark, sf_dir):
    return trades.pnl(closed_trades(spark, sf_dir))


@query("trade_pnl", TRADE_SQL + f"SELECT fill_id, {rnd(['gross_pnl', 'charges', 'net_pnl', 'pnl_pct'], 2)} FROM closed")
def trade_pnl(spark, sf_dir):
    return tidy(priced_trades(spark, sf_dir), ["fill_id", "gross_pnl", "charges", "net_pnl", "pnl_pct"], 2)


def _plan_sql(name: str) -> str:
    p = COST_PLANS[name]
    buy = "(fill_id % 2 = 0)"
    reg = f"trade_value * {p.regulator!r}" if p.regulator_buy else f"CASE WHEN {buy} THEN 0 ELSE trade_value * {p.regulator!r} END"
    base = f"greatest({p.flat}, trade_value * {p.pct!r}) + trade_value * {p.exchange!r}" + (f" + {reg}" if p.levy_on_regulator else "")
    return (f"greatest({p.flat}, trade_value * {p.pct!r}) + CASE WHEN {buy} THEN trade_value * {p.stamp_buy!r} ELSE trade_value * {p.sell_tax!r} END"
            f" + {reg} + trade_value * {p.exchange!r} + ({base}) * {p.levy}")


@query("transaction_costs", q.with_(q.FILLS) + "SELECT fill_id, " + rnd([f"{_plan_sql(p)} AS {p}" for p in COST_PLANS], 3) + " FROM fills")
def transaction_costs(spark, sf_dir):
    """Charges of every fill under each plan."""
    side = F.when(C("fill_id") % 2 == 0, "BUY").otherwise("SELL")
    return tidy(tables.fills(spark, sf_dir).select("fill_id", *[trades.charges(C("trade_value"), side, p).alias(p) for p in COST_PLANS]), digits=3)


@query("charge_parts", q.with_(q.FILLS) + "SELECT fill_id, " + rnd(["0 AS brokerage", "CASE WHEN fill_id % 2 = 0 THEN 0 ELSE trade_value * 0.001 END AS sell_tax",
       "CASE WHEN fill_id % 2 = 0 THEN trade_value * 0.00015 ELSE 0 END AS stamp", "trade_value * 0.0000325 AS exchange"], 3) + " FROM fills")
def charge_parts(spark, sf_dir):
    side = F.when(C("fill_id") % 2 == 0, "BUY").otherwise("SELL")
    out = trades.costs(tables.fills(spark, sf_dir).withColumns({"side": side, "value": C("trade_value")}), "paper")
    return tidy(out.select("fill_id", *[C(f"charge_parts.{c}").alias(c) for c in ("brokerage", "sell_tax", "stamp", "exchange")]), digits=3)


SLIPPED = ["buy_fill", "sell_fill", "buy_slip", "sell_slip"]


@query("fill_slippage", q.with_(q.TICKS) + f"""SELECT event_id, {rnd(['price * (1 + h) AS buy_fill', 'price * (1 - h) AS sell_fill', 'price * 1.0005 AS buy_slip', 'price * 0.9995 AS sell_slip'], 6)}
 FROM (SELECT *, CASE symbol WHEN 'click' THEN 0.0005 WHEN 'view' THEN 0.0002 ELSE 0.001 END / CAST(2 AS DOUBLE) AS h FROM ticks)""")
def fill_slippage(spark, sf_dir):
    """Ticks of two event types carry the names of liquid symbols."""
    t = tables.ticks(spark, sf_dir)
    named = t.withColumn("symbol", F.when(C("symbol") == "click", "TCS").when(C("symbol") == "view", "NIFTY").otherwise(C("symbol")))
    return tidy(trades.fill_prices(named), ["event_id", *SLIPPED], 6)


@query("regime_levels", q.with_(q.BARS, q.VIX, q.IND, DAILY) + """SELECT ts, CASE market_regime WHEN 'high_vol_crisis' THEN CAST(0.5 AS DOUBLE) WHEN 'trending' THEN 1.2 ELSE 1 END AS size_mult,
 CASE market_regime WHEN 'mean_reverting' THEN CAST(1 AS DOUBLE) WHEN 'high_vol_crisis' THEN 2 ELSE 1.5 END AS sl_mult, CASE market_regime WHEN 'mean_reverting' THEN CAST(2 AS DOUBLE) ELSE 3 END AS tp_mult FROM dreg""")
def regime_levels(spark, sf_dir):
    reg = scoring.daily_regime(ind.adx(tables.bars(spark, sf_dir)), tables.vix(spark, sf_dir))
    return trades.regime_levels(reg).select("ts", "size_mult", "sl_mult", "tp_mult")


HELD = "held AS (SELECT symbol, CASE WHEN symbol < 'm' THEN 'LONG' ELSE 'SHORT' END AS direction, 10 AS quantity, m AS entry_price, m - 5 * CASE WHEN symbol < 'm' THEN 1 ELSE -1 END AS stop_loss, m + 60 * CASE WHEN symbol < 'm' THEN 1 ELSE -1 END AS take_profit, t0 AS entry_ts FROM (SELECT symbol, floor(avg(price)) AS m, min(ts) FILTER (ts >= TIMESTAMP '2024-01-24 12:00:00') AS t0 FROM ticks GROUP BY 1))"


def held(t):
    p = t.groupBy("symbol").agg(F.floor(F.avg("price")).cast("double").alias("entry_price"), F.min(F.when(C("ts") >= F.lit("2024-01-24 12:00:00").cast("timestamp"), C("ts"))).alias("entry_ts"))
    sign = F.when(C("symbol") < "m", 1).otherwise(-1)
    return p.select("symbol", F.when(C("symbol") < "m", "LONG").otherwise("SHORT").alias("direction"), F.lit(10).alias("quantity"), "entry_price",
                    (C("entry_price") - sign * 5).alias("stop_loss"), (C("entry_price") + sign * 60).alias("take_profit"), "entry_ts")


MARKED = """lq AS (SELECT symbol, max_by(price, row(ts, event_id)) AS price, max(price) FILTER (ts >= entry_ts) AS hi, min(price) FILTER (ts >= entry_ts) AS lo FROM ticks JOIN (SELECT symbol, entry_ts FROM held) USING (symbol) GROUP BY 1),
mk AS (SELECT h.*, price, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS sg, CASE WHEN direction = 'LONG' THEN CASE WHEN greatest(hi, entry_price) > entry_price THEN greatest(stop_loss, greatest(hi, entry_price) * 0.985) ELSE stop_loss END
 ELSE CASE WHEN least(lo, entry_price) < entry_price THEN least(stop_loss, least(lo, entry_price) * 1.015) ELSE stop_loss END END AS trailing_stop FROM held h JOIN lq USING (symbol)),
marked AS (SELECT *, quantity * price AS market_value, sg * (price - entry_price) * quantity AS unrealised_pnl, sg * (price / entry_price - 1) * 100 AS unrealised_pct,
 CASE WHEN sg * price <= sg * stop_loss THEN 'SL_HIT' WHEN sg * price >= sg * take_profit THEN 'TP_HIT' WHEN sg * trailing_stop > sg * entry_price AND sg * price <= sg * trailing_stop THEN 'TRAIL_STOP' END AS exit_flag FROM mk)"""


@query("mark_to_market", q.with_(q.TICKS, HELD, MARKED) + f"SELECT symbol, direction, {rnd(['price', 'market_value', 'unrealised_pnl', 'unrealised_pct', 'trailing_stop'])}, exit_flag FROM marked")
def mark_to_market(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    return tidy(trades.mark(held(t), t), ["symbol", "direction", "price", "market_value", "unrealised_pnl", "unrealised_pct", "trailing_stop", "exit_flag"])


@query("not_held", q.with_(q.TICKS) + "SELECT DISTINCT symbol FROM ticks WHERE symbol NOT IN (SELECT symbol FROM ticks GROUP BY 1 HAVING count(*) > 2000)")
def not_held(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    busy = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 2000")
    return trades.not_held(t.select("symbol").distinct(), busy)


@query("portfolio_summary", q.with_(q.TICKS, HELD, MARKED, q.FILLS, CLOSED) + f"""SELECT open_positions, {rnd(['market_value', 'unrealised_pnl', 'realised_pnl', 'gross_pnl', 'charges_paid', 'win_rate', 'unrealised_pnl + realised_pnl AS total_pnl'], 2)}, total_trades
 FROM (SELECT count(*) AS open_positions, sum(market_value) AS market_value, sum(unrealised_pnl) AS unrealised_pnl FROM marked),
 (SELECT count(*) AS total_trades, sum(net_pnl) AS realised_pnl, sum(gross_pnl) AS gross_pnl, sum(charges) AS charges_paid, count(*) FILTER (net_pnl > 0) * CAST(100 AS DOUBLE) / count(*) AS win_rate FROM closed)""")
def portfolio_summary(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    return tidy(trades.portfolio(trades.mark(held(t), t), priced_trades(spark, sf_dir)), digits=2)


@query("daily_pnl", TRADE_SQL + f"SELECT ts AS day, count(*) AS trades, {rnd(['sum(net_pnl) AS day_pnl'], 2)}, count(*) FILTER (net_pnl > 0) AS wins FROM closed GROUP BY 1")
def daily_pnl(spark, sf_dir):
    return tidy(trades.daily_report(priced_trades(spark, sf_dir)), digits=2)


# --- performance ------------------------------------------------------------------------

CAPITAL = 1e9
EQ = f"""eq AS MATERIALIZED (SELECT ts, {CAPITAL} + sum(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT ts, sum(net_pnl) AS c FROM closed GROUP BY 1)),
dd AS (SELECT *, max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak, equity / lag(equity) OVER (ORDER BY ts) - 1 AS r FROM eq)"""
EQ_SQL = q.with_(q.FILLS, CLOSED, EQ)


def equity(spark, sf_dir):
    flows = priced_trades(spark, sf_dir).select("ts", C("net_pnl").alias("cash"))
    return performance.equity_curve(flows, CAPITAL)


@query("equity_curve", EQ_SQL + f"SELECT ts, {rnd(['equity'], 2)} FROM eq")
def equity_curve(spark, sf_dir):
    return tidy(equity(spark, sf_dir), digits=2)


MARKED_EQUITY = """mf AS (SELECT ts, sum(cash) AS cash FROM (SELECT ts, -entry_price * quantity AS cash FROM ct UNION ALL SELECT CAST(ts + CAST(hold_days AS INTEGER) AS DATE), exit_price * quantity FROM ct) GROUP BY 1),
mm AS (SELECT CAST(ts + CAST(i AS INTEGER) AS DATE) AS ts, sum(quantity * (entry_price + (exit_price - entry_price) * i / hold_days)) AS value FROM ct, unnest(range(0, hold_days)) t(i) GROUP BY 1),
me AS (SELECT ts, 1000000 + sum(coalesce(cash, 0)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) + coalesce(value, 0) AS equity FROM mf FULL JOIN mm USING (ts))"""


@query("marked_equity", q.with_(q.FILLS, CLOSED, MARKED_EQUITY) + f"SELECT ts, {rnd(['equity'], 2)} FROM me")
def marked_equity(spark, sf_dir):
    """Equity with open positions: bought at entry, sold after `hold_days`, marked on the line between the prices."""
    t = closed_trades(spark, sf_dir)
    value = C("quantity") * C("entry_price")
    flows = t.select("ts", (-value).alias("cash")).union(t.select(F.date_add("ts", C("hold_days")), C("quantity") * C("exit_price")))
    held = t.filter("hold_days > 0").withColumn("i", F.explode(F.sequence(F.lit(0), C("hold_days") - 1)))
    marks = held.select(F.date_add("ts", C("i")).alias("ts"), (C("quantity") * (C("entry_price") + (C("exit_price") - C("entry_price")) * C("i") / C("hold_days"))).alias("value"))
    return tidy(performance.equity_curve(flows, 1_000_000.0, marks), digits=2)


@query("drawdowns", EQ_SQL + f"SELECT ts, {rnd(['peak'], 2)}, {rnd(['(equity - peak) / peak * 100 AS drawdown'])} FROM dd")
def drawdowns(spark, sf_dir):
    out = performance.drawdowns(equity(spark, sf_dir))
    return out.select("ts", near_to(C("peak"), 2).alias("peak"), near_to(C("drawdown")).alias("drawdown"))


@query("performance_summary", EQ_SQL + f"""SELECT {rnd(['total_return_pct', 'cagr_pct', 'sharpe', 'sortino', 'max_drawdown_pct', 'cagr_pct / max_drawdown_pct AS calmar'])}, {rnd(['final', 'max_drawdown_money'], 2)} FROM
 (SELECT max_by(equity, ts) AS final, (max_by(equity, ts) / {CAPITAL} - 1) * 100 AS total_return_pct, (pow(max_by(equity, ts) / {CAPITAL}, 1 / greatest(0.1, date_diff('day', min(ts), max(ts)) / 365.25)) - 1) * 100 AS cagr_pct,
 avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS sortino, abs(min((equity - peak) / peak)) * 100 AS max_drawdown_pct,
 min_by(peak - equity, row((equity - peak) / peak, ts)) AS max_drawdown_money FROM dd)""")
def performance_summary(spark, sf_dir):
    out = performance.summary(equity(spark, sf_dir), CAPITAL)
    money = ["final", "max_drawdown_money"]
    return out.select(*[near_to(C(c), 2 if c in money else 4).alias(c) for c in out.columns])


@query("trade_statistics", TRADE_SQL + f"""SELECT total_trades, winning_trades, losing_trades, {rnd(['win_rate', 'avg_win_pct', 'avg_loss_pct', 'avg_hold_days', 'trades_per_month', 'abs(avg_win_pct / avg_loss_pct) AS reward_risk'])},
 {rnd(['total_charges', 'total_slippage'], 2)} FROM (SELECT count(*) AS total_trades, count(*) FILTER (net_pnl > 0) AS winning_trades, count(*) FILTER (net_pnl <= 0) AS losing_trades,
 count(*) FILTER (net_pnl > 0) / CAST(count(*) AS DOUBLE) AS win_rate, avg(pnl_pct) FILTER (net_pnl > 0) AS avg_win_pct, avg(pnl_pct) FILTER (net_pnl <= 0) AS avg_loss_pct, avg(hold_days) AS avg_hold_days,
 count(*) / CAST(84 AS DOUBLE) AS trades_per_month, sum(charges) AS total_charges, sum(slippage) AS total_slippage FROM closed)""")
def trade_statistics(spark, sf_dir):
    out = performance.trade_stats(priced_trades(spark, sf_dir), years=7)
    counts, money = ["total_trades", "winning_trades", "losing_trades"], ["total_charges", "total_slippage"]
    return out.select(*[C(c) if c in counts else near_to(C(c), 2 if c in money else 4).alias(c) for c in out.columns])


@query("monthly_returns", EQ_SQL + f"SELECT month, {rnd(['r AS return_pct'])} FROM (SELECT month, (e / lag(e) OVER (ORDER BY month) - 1) * 100 AS r FROM (SELECT last_day(ts) AS month, max_by(equity, ts) AS e FROM eq GROUP BY 1)) WHERE r IS NOT NULL")
def monthly_returns(spark, sf_dir):
    return tidy(performance.monthly_returns(equity(spark, sf_dir)))


@query("trade_log", TRADE_SQL + f"SELECT fill_id, symbol, ts AS entry_ts, {rnd(['round(CAST(entry_price AS DECIMAL(18, 6)), 2) AS entry_price', 'round(CAST(charges AS DECIMAL(18, 6)), 2) AS charges', 'round(CAST(net_pnl AS DECIMAL(18, 6)), 2) AS net_pnl'], 2)} FROM closed")
def trade_log(spark, sf_dir):
    return tidy(performance.trade_log(priced_trades(spark, sf_dir)),
                ["fill_id", "symbol", "entry_ts", "entry_price", "charges", "net_pnl"], 2)


@query("buy_and_hold", q.with_(q.BARS) + f"""SELECT symbol, {rnd(['g * 100000 AS final_capital'], 2)}, {rnd(['(g - 1) * 100 AS total_return_pct', '(pow(g, 1 / y) - 1) * 100 AS cagr_pct', 'sharpe', 'max_drawdown_pct'])} FROM
 (SELECT symbol, max_by(close, ts) / min_by(close, ts) AS g, greatest(0.1, date_diff('day', min(ts), max(ts)) / 365.25) AS y, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, abs(min((close - peak) / peak)) * 100 AS max_drawdown_pct
 FROM (SELECT *, close / lag(close) OVER w - 1 AS r, max(close) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1 HAVING count(*) >= 10)""")
def buy_and_hold(spark, sf_dir):
    out = performance.buy_and_hold(tables.bars(spark, sf_dir))
    return out.select("symbol", *[near_to(C(c), 2 if c == "final_capital" else 4).alias(c) for c in out.columns[1:]])


@query("benchmark_alpha", q.with_(q.BARS, q.FILLS, CLOSED, EQ) + f"""SELECT symbol, {rnd(['s - (g - 1) * 100 AS alpha_return'])} FROM (SELECT symbol, max_by(close, ts) / min_by(close, ts) AS g FROM bars GROUP BY 1 HAVING count(*) >= 10),
 (SELECT (max_by(equity, ts) / {CAPITAL} - 1) * 100 AS s FROM eq)""")
def benchmark_alpha(spark, sf_dir):
    out = performance.alpha(performance.summary(equity(spark, sf_dir), CAPITAL), performance.buy_and_hold(tables.bars(spark, sf_dir)))
    return tidy(out, ["symbol", "alpha_return"])


# --- risk -------------------------------------------------------------------------------

# Limits scaled to the order values of the tables, so that every rule decides some rows.
LIMITS = RiskConfig(total_capital=20_000_000.0, max_position_size=0.0145, max_trades_per_day=5, max_capital_deployed=0.05,
                    max_daily_loss_pct=0.001, max_weekly_loss_pct=0.0015, max_drawdown_pct=0.02, min_tech_score=55.0)
STATE = f"""st AS MATERIALIZED (SELECT ts, n AS trades_today, p AS pnl_today, v AS capital_deployed, {LIMITS.total_capital} + sum(p) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS current_capital
 FROM (SELECT ts, count(*) AS n, sum(pnl) AS p, sum(trade_value) AS v FROM fills GROUP BY 1)),
st1 AS (SELECT *, greatest({LIMITS.total_capital}, max(current_capital) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS peak_capital, coalesce(lag(current_capital) OVER (ORDER BY ts), {LIMITS.total_capital}) AS s0 FROM st),
st2 AS (SELECT *, coalesce(lag(peak_capital) OVER (ORDER BY ts), {LIMITS.total_capital}) AS k0, CASE WHEN s0 <= 0 OR s0 > {LIMITS.total_capital * 10} THEN {LIMITS.total_capital} ELSE s0 END AS start_capital FROM st1),
state AS (SELECT *, CASE WHEN k0 < start_capital OR k0 > {LIMITS.total_capital * 10} THEN greatest(start_capital, {LIMITS.total_capital}) ELSE k0 END AS start_peak,
 first_value(start_capital) OVER (PARTITION BY isoyear(ts), week(ts) ORDER BY ts) AS week_start_capital FROM st2)"""
RISK_SQL = q.with_(q.FILLS, STATE)


@query("daily_risk_state", RISK_SQL + f"SELECT ts, trades_today, {rnd(['pnl_today', 'capital_deployed', 'current_capital', 'peak_capital', 'start_capital', 'start_peak'], 2)} FROM state")
def daily_risk_state(spark, sf_dir):
    return tidy(risk.daily_state(tables.fills(spark, sf_dir), LIMITS), digits=2)


@query("week_start_capital", RISK_SQL + f"SELECT ts, {rnd(['week_start_capital'], 2)} FROM state")
def week_start_capital(spark, sf_dir):
    return tidy(risk.week_start(risk.daily_state(tables.fills(spark, sf_dir), LIMITS)), ["ts", "week_start_capital"], 2)


@query("risk_status", RISK_SQL + f"SELECT ts, {rnd(['pnl_today / 2e7 * 100 AS pnl_today_pct', 'capital_deployed / 2e7 * 100 AS capital_deployed_pct', '(peak_capital - current_capital) / peak_capital * 100 AS drawdown_pct'])} FROM state")
def risk_status(spark, sf_dir):
    out = risk.status(risk.daily_state(tables.fills(spark, sf_dir), LIMITS), LIMITS)
    return tidy(out, ["ts", "pnl_today_pct", "capital_deployed_pct", "drawdown_pct"])


@query("trade_verdicts", q.with_(q.FILLS, STATE, """rb AS (SELECT f.*, start_capital, start_peak, week_start_capital, coalesce(sum(pnl) OVER w, 0) AS p, count(*) OVER w AS n, coalesce(sum(trade_value) OVER w, 0) AS used
 FROM fills f JOIN state USING (ts) WINDOW w AS (PARTITION BY ts ORDER BY fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rn AS (SELECT *, start_capital + p AS now, greatest(start_peak, start_capital + p) AS peak FROM rb)""") + """SELECT fill_id, CASE WHEN ml_confidence < 60 THEN 'LOW_CONFIDENCE' WHEN tech_score < 55 THEN 'LOW_SCORE' WHEN p < -20000 THEN 'DAILY_LOSS'
 WHEN week_start_capital > 0 AND now > 0 AND (week_start_capital - now) / week_start_capital > 0.0015 THEN 'WEEKLY_LOSS' WHEN peak > 0 AND (peak - now) / peak > 0.02 THEN 'DRAWDOWN' WHEN n >= 5 THEN 'TRADE_COUNT'
 WHEN trade_value > 290000 THEN 'POSITION_SIZE' WHEN used + trade_value > 1000000 THEN 'DEPLOYMENT' ELSE 'APPROVED' END AS verdict FROM rn""")
def trade_verdicts(spark, sf_dir):
    return risk.verdicts(tables.fills(spark, sf_dir), LIMITS, width=512).select("fill_id", "verdict")


# Limits and hours that let every rule of the life of positions decide some rows; options end first.
LIFE = RiskConfig(total_capital=20_000_000.0, max_position_size=0.0145, max_single_option=0.0135, max_trades_per_day=6, max_open_positions=5, max_capital_deployed=0.045,
                  max_daily_loss_pct=0.0008, max_weekly_loss_pct=0.0012, max_drawdown_pct=0.004, min_tech_score=55.0, no_options_after="13:30", max_iv_to_trade=60.0)
LIFE_VIEW = """po AS (SELECT fill_id, trade_value, pnl, ml_confidence, tech_score, fill_id % 4 = 0 AS is_option, CAST(fill_id % 80 AS DOUBLE) AS iv,
 CAST(ts AS TIMESTAMP) + (555 + fill_id * 7 % 400) * INTERVAL '1' MINUTE AS opened_at, CAST(ts AS TIMESTAMP) + (560 + fill_id * 7 % 400 + fill_id * 11 % 2000) * INTERVAL '1' MINUTE AS closed_at FROM fills)"""
LIFE_SQL = LIFE_VIEW + """, ev AS (SELECT CAST(tm AS DATE) AS day, * FROM (SELECT opened_at AS tm, 2 AS rank, fill_id AS id, CAST(0 AS DOUBLE) AS v, 0 AS h, 0 AS t, CAST(0 AS DOUBLE) AS p, ml_confidence, tech_score, is_option, iv, trade_value FROM po
 UNION ALL SELECT opened_at, 3, fill_id, trade_value, 1, 1, 0, NULL, NULL, NULL, NULL, NULL FROM po UNION ALL SELECT closed_at, 0, fill_id, -trade_value, -1, 0, pnl, NULL, NULL, NULL, NULL, NULL FROM po
 UNION ALL SELECT DISTINCT CAST(ts AS TIMESTAMP) + INTERVAL '720' MINUTE, 1, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL FROM fills)),
s1 AS (SELECT *, sum(v) OVER w AS sv, sum(h) OVER w AS sh, sum(t) OVER w AS n, sum(p) OVER w AS g FROM ev WINDOW w AS (PARTITION BY day ORDER BY tm, rank, id ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, sv - least(0, min(sv) OVER w) AS used, sh - least(0, min(sh) OVER w) AS held, greatest(0, max(g) OVER w) AS high FROM s1 WINDOW w AS (PARTITION BY day ORDER BY tm, rank, id ROWS UNBOUNDED PRECEDING)),
d1 AS (SELECT day, sum(p) AS total, max(high) AS most FROM s2 GROUP BY 1),
d2 AS (SELECT *, 2e7 + coalesce(sum(total) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d1),
d3 AS (SELECT day, start, greatest(2e7, coalesce(max(start + most) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS top, first_value(start) OVER (PARTITION BY isoyear(day), week(day) ORDER BY day) AS ws FROM d2),
s3 AS (SELECT *, start + g AS now, greatest(top, start + high) AS peak, strftime(tm, '%H:%M') AS clock, CASE WHEN g < -16000 THEN 'DAILY_LOSS' WHEN ws > 0 AND start + g > 0 AND (ws - start - g) / ws > 0.0012 THEN 'WEEKLY_LOSS'
 WHEN greatest(top, start + high) > 0 AND (greatest(top, start + high) - start - g) / greatest(top, start + high) > 0.004 THEN 'DRAWDOWN' END AS loss FROM s2 JOIN d3 USING (day)),
s4 AS (SELECT *, CASE WHEN clock >= '15:00' THEN 'CUTOFF_TIME' WHEN is_option AND clock >= '13:30' THEN 'OPTION_CUTOFF' WHEN ml_confidence < 60 THEN 'LOW_CONFIDENCE' WHEN tech_score < 55 THEN 'LOW_SCORE' END AS early FROM s3),
s5 AS (SELECT *, CASE WHEN rank = 2 THEN early IS NULL AND loss IS NOT NULL ELSE rank = 0 AND g < -16000 END AS breach, row_number() OVER (PARTITION BY day ORDER BY tm, rank, id) AS k FROM s4),
s6 AS (SELECT *, coalesce(max(CASE WHEN breach THEN k END) OVER w > coalesce(max(CASE WHEN rank = 1 THEN k END) OVER w, 0), false) AS halted FROM s5 WINDOW w AS (PARTITION BY day ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT id AS order_id, held AS open_positions, halted, CASE WHEN halted THEN 'HALTED' WHEN early IS NOT NULL THEN early WHEN loss IS NOT NULL THEN loss WHEN n >= 6 THEN 'TRADE_COUNT' WHEN held >= 5 THEN 'OPEN_POSITIONS'
 WHEN trade_value > CASE WHEN is_option THEN 270000 ELSE 290000 END THEN 'POSITION_SIZE' WHEN used + trade_value > 900000 THEN 'DEPLOYMENT' WHEN is_option AND iv > 60 THEN 'HIGH_IV' ELSE 'APPROVED' END AS verdict FROM s6 WHERE rank = 2)"""


def life(spark, sf_dir):
    """Verdicts on fills as orders that open on the minute they are asked for, with a lift of halts each noon."""
    f = tables.fills(spark, sf_dir)
    minute, day = F.expr("INTERVAL '1' MINUTE"), F.to_timestamp("ts")
    opened, k = 555 + C("fill_id") * 7 % 400, C("fill_id")
    orders = f.select(k.alias("order_id"), (day + opened * minute).alias("at"), "trade_value", "ml_confidence", "tech_score", (k % 4 == 0).alias("is_option"), (k % 80).cast("double").alias("iv"))
    positions = f.select(k.alias("position_id"), (day + opened * minute).alias("opened_at"), (day + (opened + 5 + k * 11 % 2000) * minute).alias("closed_at"), "trade_value", "pnl")
    lifts = f.select((F.to_timestamp("ts") + F.expr("INTERVAL '720' MINUTE")).alias("at")).distinct()
    return risk.life_verdicts(orders, positions, lifts, LIFE)


@query("life_verdicts", q.with_(q.FILLS, LIFE_SQL) + "SELECT order_id, CAST(open_positions AS BIGINT) AS open_positions, CAST(halted AS INTEGER) AS halted, verdict FROM lv")
def life_verdicts(spark, sf_dir):
    return life(spark, sf_dir).select("order_id", C("open_positions").cast("long").alias("open_positions"), C("halted").cast("int").alias("halted"), "verdict")


@query("refusal_counts", q.with_(q.FILLS, LIFE_SQL) + "SELECT verdict, count(*) AS orders FROM lv GROUP BY 1")
def refusal_counts(spark, sf_dir):
    return life(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("orders"))


@query("position_sizing", q.with_(q.FILLS) + """SELECT fill_id, CAST(greatest(1, least(floor(floor(10000 / greatest(e * 0.001, CASE WHEN fill_id % 2 = 0 THEN CASE WHEN e - s > 0 THEN e - s ELSE e * 0.02 END
 ELSE CASE WHEN e - s < 0 THEN s - e ELSE e * 0.02 END END)) * least(1.5, ml_confidence / 100 + 0.5)), floor(50000 / greatest(e, 0.01)))) AS BIGINT) AS quantity
 FROM (SELECT *, trade_value / 100 AS e, trade_value / 100 * (1 + (fill_id % 5 - 2) / CAST(50 AS DOUBLE)) AS s FROM fills)""")
def position_sizing(spark, sf_dir):
    e = C("trade_value") / 100
    df = tables.fills(spark, sf_dir).withColumns({
        "capital": F.lit(1e6), "entry": e, "stop": e * (1 + (C("fill_id") % 5 - 2) / 50.0), "atr": e * 0.02, "confidence": C("ml_confidence"),
        "direction": F.when(C("fill_id") % 2 == 0, "BUY").otherwise("SELL")})
    return risk.position_size(df).select("fill_id", "quantity")


@query("half_kelly", TRADE_SQL + f"""SELECT symbol, {rnd(['least(greatest(0, (w / l * p - (1 - p)) / (w / l) / 2), 0.05) AS kelly_fraction'])} FROM (SELECT symbol, avg(net_pnl) FILTER (net_pnl > 0) AS w, -avg(net_pnl) FILTER (net_pnl <= 0) AS l,
 count(*) FILTER (net_pnl > 0) / CAST(count(*) AS DOUBLE) AS p FROM closed GROUP BY 1)""")
def half_kelly(spark, sf_dir):
    win = C("net_pnl") > 0
    stats = priced_trades(spark, sf_dir).groupBy("symbol").agg(
        F.avg(F.when(win, C("net_pnl"))).alias("avg_win"), (-F.avg(F.when(~win, C("net_pnl")))).alias("avg_loss"),
        (F.count_if(win) / F.count(F.lit(1))).alias("win_rate"))
    return tidy(risk.half_kelly(stats), ["symbol", "kelly_fraction"])


@query("sector_exposure", q.with_(q.FILLS) + f"SELECT CASE WHEN symbol < '3' THEN 'fast' ELSE 'slow' END AS sector, {rnd(['sum(trade_value) AS exposure', 'sum(trade_value) / 1e6 AS share'], 2)}, CAST(sum(trade_value) / 1e6 > 0.25 AS INTEGER) AS over_cap FROM fills GROUP BY 1")
def sector_exposure(spark, sf_dir):
    f = tables.fills(spark, sf_dir)
    sectors = f.select("symbol", F.when(C("symbol") < "3", "fast").otherwise("slow").alias("sector")).distinct()
    return tidy(risk.sector_exposure(f, sectors), digits=2)


# --- models -----------------------------------------------------------------------------

SMALL = models.ModelConfig(trees=10, depth=4, rounds=5, boost_depth=3)
INPUTS = ["ret_1d", "ret_5d", "ret_20d", "realized_vol_20d", "vol_ratio", "body_ratio", "close_loc", "gap_pct"]


def training_table(spark, sf_dir):
    """All 80 features and labels of all bars, kept once for the several passes of fitting."""
    df = fe.features(tables.bars(spark, sf_dir), market(spark, sf_dir))
    df = labels.sharpe_target(labels.triple_barrier(df))
    df = df.select("symbol", "ts", "label", "target", *fe.FEATURES)
    return cut(datasets.complete(df, ["label", "target", *fe.FEATURES]))


def small_table(spark, sf_dir):
    """INPUTS and labels of all bars, kept once for the several passes of fitting."""
    fams = [ind.ATR, fe.RETURNS, fe.VOLATILITY, fe.CANDLES, fe.GAPS, fe.VOLUME]
    df = ind.run(tables.bars(spark, sf_dir), fams, ind.CFG)
    df = labels.sharpe_target(labels.triple_barrier(df))
    df = df.select("symbol", "ts", "label", "target", *[C(f"f_{c}").alias(c) for c in INPUTS])
    return datasets.complete(df, INPUTS).persist()


@query("walk_forward_auc")
def walk_forward_auc(spark, sf_dir):
    """AUC and accuracy of the forest per fold, from out-of-fold predictions."""
    oof = models.out_of_fold(small_table(spark, sf_dir), INPUTS, k=4, cfg=SMALL)
    return models.auc(oof, "forest_prob", by=("fold",))


@query("stacked_ensemble")
def stacked_ensemble(spark, sf_dir):
    """Meta-learner over the out-of-fold members of the earlier folds, scored on the last fold."""
    oof = models.out_of_fold(small_table(spark, sf_dir), INPUTS, k=4, cfg=SMALL)
    return models.auc(models.stacked(models.stack(oof.filter("fold < 3")), oof.filter("fold = 3")))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    df = datasets.chronological_split(small_table(spark, sf_dir))
    return models.importances(models.fit(df.filter("part = 'train'"), INPUTS, SMALL), INPUTS)


@query("target_regression")
def target_regression(spark, sf_dir):
    """All features and rounds, fitted on the first 70 % of the panel, correlated on the untouched last 15 %."""
    df = datasets.chronological_split(training_table(spark, sf_dir))
    return models.target_correlation(models.fit_target(df.filter("part = 'train'"), fe.FEATURES).transform(df.filter("part = 'test'")))


AUC_SQL = f"""sv AS (SELECT symbol, {PROB_SQL} AS p, CAST(close > open AS INTEGER) AS label FROM bars),
rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / CAST(2 AS DOUBLE) AS r FROM sv)"""


@query("rank_sum_auc", q.with_(q.BARS, AUC_SQL) + f"""SELECT symbol, {rnd(['(sum(r) FILTER (label = 1) - pos * (pos + 1) / 2) / (pos * neg) AS auc', 'acc AS accuracy'])}, n FROM
 (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY symbol) AS pos, count(*) FILTER (label = 0) OVER (PARTITION BY symbol) AS neg,
 avg(CAST((p >= 0.5) = (label = 1) AS INTEGER)) OVER (PARTITION BY symbol) AS acc, count(*) OVER (PARTITION BY symbol) AS n FROM rk) GROUP BY symbol, pos, neg, acc, n""")
def rank_sum_auc(spark, sf_dir):
    return tidy(rank_sum_auc_rows(spark, sf_dir))


def rank_sum_auc_rows(spark, sf_dir):
    df = tables.bars(spark, sf_dir).select("symbol", prob().alias("prob"), (C("close") > C("open")).cast("int").alias("label"))
    return models.auc(df, by=("symbol",))


@query("auc_summary", q.with_(q.BARS, AUC_SQL) + f"""SELECT {rnd(['avg(auc) AS mean_auc', 'stddev_pop(auc) AS spread'], 6)} FROM
 (SELECT (sum(r) FILTER (label = 1) - pos * (pos + 1) / 2) / (pos * neg) AS auc FROM (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY symbol) AS pos,
 count(*) FILTER (label = 0) OVER (PARTITION BY symbol) AS neg FROM rk) GROUP BY symbol, pos, neg)""")
def auc_summary(spark, sf_dir):
    """Mean and spread of the AUC over groups."""
    return tidy(models.fold_summary(rank_sum_auc_rows(spark, sf_dir)), digits=6)


@query("trades_by_regime", q.with_(q.BARS, q.VIX, q.IND, DAILY, q.FILLS, CLOSED) + f"""SELECT coalesce(market_regime, 'unknown') AS regime, count(*) AS trades, {rnd(['sum(net_pnl) AS net_pnl'], 2)},
 count(*) FILTER (net_pnl > 0) AS wins FROM closed LEFT JOIN dreg USING (ts) GROUP BY 1""")
def trades_by_regime(spark, sf_dir):
    reg = scoring.daily_regime(ind.adx(tables.bars(spark, sf_dir)), tables.vix(spark, sf_dir))
    return tidy(performance.trades_by_regime(priced_trades(spark, sf_dir), reg), digits=2)
