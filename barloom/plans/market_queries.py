"""Options, news, source, streaming-twin and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import joins, longseries
from barloom.operators import indicators as ind, news, options
from barloom.plans import sql_base as q
from barloom.plans.registry import near, query, tidy
from barloom.plans.sql_base import rnd
from barloom.sources import readers, tables, universe
from barloom.streaming import feeds

C = F.col
OPT = q.with_(q.CONTRACTS, q.OPTIONS)


def contracts(spark, sf_dir):
    return tables.contracts(spark, sf_dir)


def strikes(spark, sf_dir):
    return options.by_strike(options.nearest_expiry(contracts(spark, sf_dir)))


@query("nearest_expiry", OPT + "SELECT trade_date, symbol, expiry_date, count(*) AS n FROM near GROUP BY ALL")
def nearest_expiry(spark, sf_dir):
    return options.nearest_expiry(contracts(spark, sf_dir)).groupBy("trade_date", "symbol", "expiry_date").agg(
        F.count(F.lit(1)).alias("n"))


@query("put_call_ratio", OPT + f"SELECT trade_date, symbol, call_oi, put_oi, {rnd(['pcr'])} FROM pcr")
def put_call_ratio(spark, sf_dir):
    return tidy(options.pcr(strikes(spark, sf_dir)))


@query("strike_pcr", OPT + f"SELECT trade_date, symbol, strike, {rnd(['round(put_oi / greatest(1, call_oi), 3) AS pcr'])} FROM strikes")
def strike_pcr(spark, sf_dir):
    return tidy(strikes(spark, sf_dir).select("trade_date", "symbol", "strike", F.round(
        C("put_oi") / F.greatest(F.lit(1), C("call_oi")), 3).alias("pcr")))


@query("atm_strike", OPT + f"SELECT trade_date, symbol, atm_strike, {rnd(['atm_iv'])} FROM atm JOIN iv USING (trade_date, symbol)")
def atm_strike(spark, sf_dir):
    return tidy(options.atm_iv(options.atm(strikes(spark, sf_dir))), ["trade_date", "symbol", "atm_strike", "atm_iv"])


@query("rounded_spot", q.with_(q.TICKS) + """SELECT event_id, CAST(CASE WHEN abs(price / 5 - floor(price / 5) - 0.5) < 1e-12 THEN 2 * round(price / 10) ELSE round(price / 5) END * 5 AS DOUBLE) AS strike FROM ticks""")
def rounded_spot(spark, sf_dir):
    """The strike next to a live spot, halves to the even multiple."""
    return tables.ticks(spark, sf_dir).select("event_id", options.rounded_spot(C("price"), 5.0).alias("strike"))


PAIN = OPT + f"SELECT trade_date, symbol, max_pain, {rnd(['pain'])} FROM mp"


@query("max_pain", PAIN)
def max_pain(spark, sf_dir):
    return tidy(options.max_pain(strikes(spark, sf_dir)))


@query("max_pain_by_join", PAIN)
def max_pain_by_join(spark, sf_dir):
    return tidy(options.max_pain_by_join(strikes(spark, sf_dir)))


@query("daily_options_summary", OPT + f"SELECT trade_date, symbol, {rnd(['pcr', 'atm_iv', 'max_pain'])}, call_oi, put_oi FROM summary")
def daily_options_summary(spark, sf_dir):
    return tidy(options.daily_summary(contracts(spark, sf_dir)))


@query("iv_rank", OPT + f"SELECT trade_date, symbol, {rnd(['iv_rank'])} FROM ivr")
def iv_rank(spark, sf_dir):
    return tidy(options.iv_rank(options.daily_summary(contracts(spark, sf_dir))), ["trade_date", "symbol", "iv_rank"])


@query("table_status", OPT + "SELECT min(trade_date) AS earliest, max(trade_date) AS latest, count(DISTINCT trade_date) AS trading_days FROM summary")
def table_status(spark, sf_dir):
    return options.table_status(options.daily_summary(contracts(spark, sf_dir)))


@query("series_extract", OPT + f"SELECT trade_date AS ts, {rnd(['pcr'])} FROM summary WHERE symbol = 'Brand#2'")
def series_extract(spark, sf_dir):
    return tidy(options.series(options.daily_summary(contracts(spark, sf_dir)), "Brand#2", "pcr"))


WINDOW = """cw AS (SELECT s.*, row_number() OVER (PARTITION BY trade_date, symbol ORDER BY strike) AS i, atm_strike AS atm
 FROM strikes s JOIN atm a USING (trade_date, symbol)),
win AS (SELECT cw.* FROM cw JOIN (SELECT trade_date, symbol, i AS mid_i FROM cw WHERE strike = atm) USING (trade_date, symbol) WHERE abs(i - mid_i) <= 5)"""


def chain(spark, sf_dir):
    s = strikes(spark, sf_dir)
    at = options.atm(s).select("trade_date", "symbol", C("atm_strike").alias("atm"))
    return s.join(at, ["trade_date", "symbol"])


@query("chain_window", q.with_(q.CONTRACTS, q.OPTIONS, WINDOW) + "SELECT trade_date, symbol, strike, call_oi, put_oi FROM win")
def chain_window(spark, sf_dir):
    return options.chain_window(chain(spark, sf_dir), 5).select("trade_date", "symbol", "strike", "call_oi", "put_oi")


@query("oi_levels", OPT + """SELECT trade_date, symbol, a.rank AS rank, support, resistance FROM
 (SELECT trade_date, symbol, strike AS support, CAST(row_number() OVER (PARTITION BY trade_date, symbol ORDER BY put_oi DESC, strike) AS INTEGER) AS rank FROM strikes) a
 JOIN (SELECT trade_date, symbol, strike AS resistance, CAST(row_number() OVER (PARTITION BY trade_date, symbol ORDER BY call_oi DESC, strike) AS INTEGER) AS rank FROM strikes) b
 USING (trade_date, symbol, rank) WHERE rank <= 3""")
def oi_levels(spark, sf_dir):
    return options.oi_levels(strikes(spark, sf_dir))


LADDER = ("CASE WHEN pcr > 1.3 THEN 'Strongly Bullish' WHEN pcr > 1.0 THEN 'Bullish' WHEN pcr < 0.7 THEN 'Strongly Bearish' "
          "WHEN pcr < 1.0 THEN 'Bearish' ELSE 'Neutral' END")


@query("options_sentiment", OPT + f"SELECT trade_date, symbol, {LADDER} AS sentiment, "
       f"{rnd(['round(least(greatest((atm_iv - 10) / 40 * 100, 0), 100), 1) AS rough_iv_rank'])} FROM summary")
def options_sentiment(spark, sf_dir):
    out = options.live_iv_rank(options.sentiment(options.daily_summary(contracts(spark, sf_dir))))
    return tidy(out, ["trade_date", "symbol", "sentiment", "rough_iv_rank"])


# Contracts priced against a spot of the at-the-money strike, with the proxy volatility.
PRICED = f"""pz AS (SELECT c.trade_date, c.symbol, c.strike, c.option_type, CAST(c.settle_price AS DOUBLE) AS market_price, c.volume, a.atm_strike + 10 AS spot,
 greatest(CAST(1 AS DOUBLE), date_diff('day', c.trade_date, c.expiry_date)) / 365 AS t, CAST(0.065 AS DOUBLE) AS r, greatest(atm_iv, CAST(15 AS DOUBLE)) / 100 AS v
 FROM near c JOIN atm a USING (trade_date, symbol) JOIN iv USING (trade_date, symbol)),
pd AS (SELECT *, (ln(spot / strike) + (r + v * v * 0.5) * t) / (v * sqrt(t)) AS d1, strike * exp(-r * t) AS pv FROM pz),
pn AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM pd)"""


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


def cdf(x: str) -> str:
    k = f"(1 / (1 + CAST(0.2316419 AS DOUBLE) * abs({x})))"
    terms = " + ".join(f"CAST({b!r} AS DOUBLE) * pow({k}, {i})" for i, b in enumerate(
        (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1))
    upper = f"(1 - {pdf(x)} * ({terms}))"
    return f"CASE WHEN ({x}) >= 0 THEN {upper} ELSE 1 - {upper} END"


def priced(spark, sf_dir):
    near_ = options.nearest_expiry(contracts(spark, sf_dir))
    at = options.atm_iv(options.atm(options.by_strike(near_))).select("trade_date", "symbol", "atm_strike", "atm_iv")
    return near_.join(at, ["trade_date", "symbol"]).withColumns({
        "spot": C("atm_strike") + 10.0, "rate": F.lit(0.065), "sigma": F.greatest(C("atm_iv"), F.lit(15.0)) / 100,
        "years": F.greatest(F.lit(1), F.datediff("expiry_date", "trade_date")) / 365,
        "market_price": C("settle_price")})


OPTION_KEY = ["trade_date", "symbol", "strike", "option_type"]


@query("black_scholes", q.with_(q.CONTRACTS, q.OPTIONS, PRICED) + "SELECT trade_date, symbol, strike, option_type, " + rnd([
    f"greatest(CAST(0 AS DOUBLE), CASE WHEN option_type = 'CE' THEN spot * ({cdf('d1')}) - pv * ({cdf('d2')}) "
    f"ELSE pv * ({cdf('-d2')}) - spot * ({cdf('-d1')}) END) AS bs_price"], 3) + " FROM pn")
def black_scholes(spark, sf_dir):
    return tidy(options.price(priced(spark, sf_dir)), [*OPTION_KEY, "bs_price"], 3)


GREEKS = {
    "delta": (f"CASE WHEN option_type = 'CE' THEN ({cdf('d1')}) ELSE ({cdf('d1')}) - 1 END", 4),
    "gamma": (f"{pdf('d1')} / (spot * v * sqrt(t))", 6),
    "theta": (f"(-(spot * {pdf('d1')} * v) / (2 * sqrt(t)) + CASE WHEN option_type = 'CE' THEN -r * pv * ({cdf('d2')}) ELSE r * pv * ({cdf('-d2')}) END) / 365", 2),
    "vega": (f"spot * {pdf('d1')} * sqrt(t) / 100", 2),
    "rho": (f"CASE WHEN option_type = 'CE' THEN pv * t * ({cdf('d2')}) ELSE -pv * t * ({cdf('-d2')}) END / 100", 4)}


@query("option_greeks", q.with_(q.CONTRACTS, q.OPTIONS, PRICED) + "SELECT trade_date, symbol, strike, option_type, "
       + ", ".join(f"round({e}, {d}) + 0 AS {n}" for n, (e, d) in GREEKS.items()) + " FROM pn")
def option_greeks(spark, sf_dir):
    return options.greeks(priced(spark, sf_dir)).select(*OPTION_KEY, *GREEKS)


def _worth(v: str) -> str:
    """Price of an option at a volatility, as SQL over the columns of pz."""
    d1 = f"((ln(spot / strike) + (r + ({v}) * ({v}) * 0.5) * t) / (({v}) * sqrt(t)))"
    call = f"(spot * ({cdf(d1)}) - strike * exp(-r * t) * ({cdf(f'{d1} - ({v}) * sqrt(t)')}))"
    return f"greatest(CAST(0 AS DOUBLE), CASE WHEN option_type = 'CE' THEN {call} ELSE {call} - spot + strike * exp(-r * t) END)"


BISECTION = f"""bs AS (SELECT *, CAST(1e-6 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS k FROM pz UNION ALL SELECT * EXCLUDE (lo, hi, k, w), CASE WHEN w < market_price THEN (lo + hi) / 2 ELSE lo END,
 CASE WHEN w < market_price THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, {_worth('(lo + hi) / 2')} AS w FROM bs WHERE k < 60))"""


@query("implied_volatility", q.with_(q.CONTRACTS, q.OPTIONS, PRICED, BISECTION) + f"""SELECT trade_date, symbol, strike, option_type, {rnd(['CASE WHEN able THEN round((lo + hi) / 2, 4) ELSE 0 END AS iv'], 3)} FROM (SELECT *,
 market_price > 0 AND market_price >= greatest(0, CASE WHEN option_type = 'CE' THEN spot - strike ELSE strike - spot END) AND {_worth('CAST(10 AS DOUBLE)')} >= market_price
 AND {_worth('CAST(1e-6 AS DOUBLE)')} <= market_price AS able FROM bs WHERE k = 60)""")
def implied_volatility(spark, sf_dir):
    return tidy(options.implied_vol(priced(spark, sf_dir)), [*OPTION_KEY, "iv"], 3)


@query("pcr_trend", OPT + f"""SELECT symbol, {rnd(['current', 'start', 'round((current - start) / n, 4) AS slope'])}, n AS n_samples,
 CASE WHEN (current - start) / n > 0.02 THEN 'rising' WHEN (current - start) / n < -0.02 THEN 'falling' ELSE 'flat' END AS trend,
 CASE WHEN (current - start) / n > 0.02 THEN 'Bearish' WHEN (current - start) / n < -0.02 THEN 'Bullish' ELSE 'Neutral' END AS signal FROM
 (SELECT symbol, max_by(pcr, trade_date) AS current, min_by(pcr, trade_date) AS start, count(*) AS n FROM
 (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 10) GROUP BY 1)""")
def pcr_trend(spark, sf_dir):
    history = options.daily_summary(contracts(spark, sf_dir)).withColumn("ts", C("trade_date"))
    return tidy(options.pcr_trend(history), ["symbol", "current", "start", "slope", "n_samples", "trend", "signal"])


@query("kept_readings", OPT + f"""SELECT symbol, trade_date, {rnd(['pcr'])} FROM summary
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 60""")
def kept_readings(spark, sf_dir):
    out = options.keep_readings(options.daily_summary(contracts(spark, sf_dir)), 60, order="trade_date")
    return tidy(out, ["symbol", "trade_date", "pcr"])


RECO = f"""wanted AS (SELECT trade_date, symbol, atm_strike, CASE WHEN pcr > 1.0 THEN 'BUY' ELSE 'SELL' END AS signal FROM pcr JOIN atm USING (trade_date, symbol)),
tgt AS (SELECT *, atm_strike + CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * 200 * k AS strike, CASE WHEN signal = 'BUY' THEN 'CE' ELSE 'PE' END AS option_type
 FROM wanted CROSS JOIN range(3) g(k)),
cand AS (SELECT trade_date, symbol, strike, option_type, greatest(1, CAST(floor(50000 / (market_price * 50)) AS BIGINT)) AS max_lots,
 abs(round({GREEKS['delta'][0]}, 4) - 0.5) * -10 + least(volume, 10000) / CAST(1000 AS DOUBLE) AS score FROM pn JOIN tgt USING (trade_date, symbol, strike, option_type) WHERE market_price > 0)"""


@query("strike_recommendation", q.with_(q.CONTRACTS, q.OPTIONS, PRICED, RECO) + f"""SELECT trade_date, symbol, strike, option_type, max_lots, {rnd(['score'])},
 CAST(row_number() OVER (PARTITION BY trade_date, symbol ORDER BY score DESC, strike) AS INTEGER) AS rank FROM cand""")
def strike_recommendation(spark, sf_dir):
    """One or two steps out of the money, for the side the put-call ratio points to."""
    s = strikes(spark, sf_dir)
    signals = options.pcr(s).join(options.atm(s), ["trade_date", "symbol"]).select(
        "trade_date", "symbol", F.when(C("pcr") > 1.0, "BUY").otherwise("SELL").alias("signal"),
        C("atm_strike").alias("atm"), F.lit(200.0).alias("step"), F.lit(50).alias("lot_size"))
    rows = options.greeks(priced(spark, sf_dir)).select(*OPTION_KEY, C("settle_price").alias("ltp"), "delta", "volume")
    return tidy(options.recommend(rows, signals), [*OPTION_KEY, "max_lots", "score", "rank"])


# --- sources ----------------------------------------------------------------------------


@query("clean_contracts", q.with_(q.CONTRACTS) + """SELECT trade_date, symbol, expiry_date, strike, option_type, CAST(open_int AS BIGINT) AS open_int,
 CAST(settle_price AS DOUBLE) AS settle_price, CAST(volume AS BIGINT) AS volume FROM contracts WHERE symbol IN ('Brand#1', 'Brand#2')""")
def clean_contracts(spark, sf_dir):
    """The contract table written out as raw text (padded, with thousands commas, every row twice) and read back."""
    c = contracts(spark, sf_dir)
    commas = lambda x, d=2: F.format_number(x, d)
    raw = c.select(
        C("trade_date"), F.lit(" OPTIDX ").alias(" instrument"), F.concat(F.lit(" "), "symbol").alias("SYMBOL "),
        F.date_format("expiry_date", "dd-MMM-yyyy").alias("EXPIRY_DT"), commas(C("strike")).alias("STRIKE_PR"),
        C("option_type").alias("OPTION_TYP"), commas(C("open_int"), 0).alias("OPEN_INT"), F.lit("").alias("CHG_IN_OI"),
        commas(C("settle_price")).alias("SETTLE_PR"), F.lit("").alias("CLOSE"), commas(C("volume"), 0).alias("CONTRACTS"),
        F.lit(2).alias("line"))
    stale = raw.withColumns({"line": F.lit(1), "SETTLE_PR": F.lit("1.00")})
    bad = raw.withColumns({"line": F.lit(3), "STRIKE_PR": F.lit("n/a")})
    out = readers.clean_contracts(raw.unionByName(stale).unionByName(bad), tables.INDEX_SYMBOLS[:2])
    return out.select("trade_date", "symbol", "expiry_date", "strike", "option_type", "open_int", "settle_price", "volume")


@query("missing_days", q.with_(q.BARS) + """SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(m + 1, DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d
 FROM (SELECT max(ts) AS m FROM bars)) WHERE isodow(d) < 6""")
def missing_days(spark, sf_dir):
    """Weekdays to ingest after the last stored day."""
    stored = tables.bars(spark, sf_dir).select(C("ts").alias("trade_date"))
    return readers.missing_days(stored, "1995-01-01", "2002-12-31")


@query("chain_flatten", OPT + "SELECT trade_date, symbol, strike, CAST(call_oi AS BIGINT) AS ce_oi, CAST(put_oi AS BIGINT) AS pe_oi, "
       f"{rnd(['coalesce(call_settle, 0) AS ce_ltp'])} FROM strikes")
def chain_flatten(spark, sf_dir):
    """Option chains rebuilt as nested JSON per (date, symbol) and flattened again."""
    return tidy(readers.flatten_chain(chain_payloads(spark, sf_dir)),
                ["trade_date", "symbol", "strike", "ce_oi", "pe_oi", "ce_ltp"])


def chain_payloads(spark, sf_dir):
    side = lambda oi, ltp: F.when(C(oi) > 0, F.struct(ltp.alias("lastPrice"), C(oi).alias("openInterest")))
    exp = F.date_format("expiry_date", "dd-MMM-yyyy")
    row = F.struct(exp.alias("expiryDate"), C("strike").alias("strikePrice"),
                   side("call_oi", C("call_settle")).alias("CE"), side("put_oi", F.lit(1.0)).alias("PE"))
    return strikes(spark, sf_dir).groupBy("trade_date", "symbol", "expiry_date").agg(F.collect_list(row).alias("d")).select(
        "trade_date", "symbol", F.to_json(F.struct(F.struct(F.lit(1.0).alias("underlyingValue"),
                                                            F.array(exp).alias("expiryDates"), C("d").alias("data")).alias("records"))).alias("payload"))


@query("minute_readings", OPT + f"SELECT symbol, CAST(trade_date AS TIMESTAMP) AS ts, call_oi, put_oi, {rnd(['round(put_oi / greatest(1, call_oi), 3) AS pcr'])} FROM pcr")
def minute_readings(spark, sf_dir):
    """Put-call reading of every chain snapshot (the batch form of the stream)."""
    payloads = chain_payloads(spark, sf_dir).withColumn("ts", C("trade_date").cast("timestamp_ntz"))
    return tidy(feeds.chain_readings(payloads.select("symbol", "ts", "payload")))


@query("bars_source", q.with_(q.BARS) + f"SELECT symbol, ts, {rnd(['open', 'high', 'low', 'close', 'volume'])} FROM bars")
def bars_source(spark, sf_dir):
    return tidy(tables.bars(spark, sf_dir))


@query("bars_round_trip", q.with_(q.BARS) + f"SELECT symbol, ts, {rnd(['open', 'high', 'low', 'close', 'volume'])} FROM bars WHERE ts BETWEEN DATE '1996-06-01' AND DATE '1998-03-31'")
def bars_round_trip(spark, sf_dir):
    """Bars written to files by year and read back for a range of dates."""
    from uuid import uuid4

    from barloom.session import checkpoint_folder
    path = f"{checkpoint_folder(spark).rstrip('/')}/bars-{uuid4().hex}"
    readers.write_bars(tables.bars(spark, sf_dir).withColumn("close_raw", C("close")), path)
    return tidy(readers.read_bars(spark, path, "1996-06-01", "1998-03-31"), ["symbol", "ts", "open", "high", "low", "close", "volume"])


@query("normalised_bars", q.with_(q.BARS) + f"SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, {rnd(['close', 'volume'])} FROM bars WHERE volume > 10")
def normalised_bars(spark, sf_dir):
    raw = tables.bars(spark, sf_dir).withColumn("close", F.when(C("volume") > 10, C("close")))
    return tidy(readers.normalise_bars(raw), ["symbol", "ts", "close", "volume"])


@query("dual_track_close", q.with_(q.BARS) + f"""SELECT symbol, ts, {rnd(['coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), close) AS close_raw'])}
 FROM (SELECT *, CASE WHEN ts = min(ts) OVER (PARTITION BY symbol, date_trunc('month', ts)) THEN close * 2 END AS raw FROM bars)""")
def dual_track_close(spark, sf_dir):
    b = tables.bars(spark, sf_dir)
    first = b.groupBy("symbol", F.trunc("ts", "month")).agg(F.min("ts").alias("ts"), F.min_by("close", "ts").alias("close"))
    raw = first.select("symbol", "ts", (C("close") * 2).alias("close"))  # a raw close on the first bar of each month
    return tidy(readers.dual_track(b, raw), ["symbol", "ts", "close_raw"])


@query("universe_filter", q.with_(q.BARS) + "SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 48) GROUP BY 1")
def universe_filter(spark, sf_dir):
    members = tables.table(spark, sf_dir, "part").filter("p_size > 48").select(
        F.lit("large_parts").alias("name"), C("p_brand").alias("symbol")).distinct()
    return universe.in_universe(tables.bars(spark, sf_dir), members, "large_parts").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("size_buckets", """SELECT n_name AS symbol, CASE WHEN n_regionkey = 1 THEN 'large' WHEN n_regionkey = 2 THEN 'mid' ELSE 'small' END AS size_bucket FROM nation""")
def size_buckets(spark, sf_dir):
    nation = tables.table(spark, sf_dir, "nation")
    sets = nation.filter("n_regionkey IN (1, 2)").select(
        F.when(C("n_regionkey") == 1, "large").otherwise("mid").alias("name"), C("n_name").alias("symbol"))
    return universe.size_bucket(nation.select(C("n_name").alias("symbol")), sets).select("symbol", "size_bucket")


@query("feed_names", "SELECT DISTINCT p_brand AS symbol, CASE WHEN p_brand = 'Brand#5' THEN 'FIVE.X' ELSE p_brand || '.NS' END AS feed_name FROM part")
def feed_names(spark, sf_dir):
    symbols = tables.table(spark, sf_dir, "part").select(C("p_brand").alias("symbol")).distinct()
    return universe.feed_names(symbols, universe.alias_table(spark, {"Brand#5": "FIVE.X"})).select("symbol", "feed_name")


@query("minimum_history", q.with_(q.BARS) + "SELECT symbol, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 1500")
def minimum_history(spark, sf_dir):
    return readers.min_history(tables.bars(spark, sf_dir), 1500).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("date_range", q.with_(q.BARS) + "SELECT symbol, count(*) AS n FROM bars WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' GROUP BY 1")
def date_range(spark, sf_dir):
    return readers.date_range(tables.bars(spark, sf_dir), "1997-01-01", "1998-06-30").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("session_hours", q.with_(q.TICKS) + """SELECT session, off_hours, count(*) AS n FROM (SELECT NOT (isodow(ts) < 6 AND strftime(ts, '%H:%M') BETWEEN '09:15' AND '15:35') AS off_hours, CASE WHEN isodow(ts) < 6 AND strftime(ts, '%H:%M:%S') BETWEEN '09:15:00' AND '15:30:00' THEN 'open'
 WHEN strftime(ts, '%H:%M:%S') >= '09:00:00' AND strftime(ts, '%H:%M:%S') < '09:15:00' THEN 'pre_open' ELSE 'closed' END AS session FROM ticks) GROUP BY 1, 2""")
def session_hours(spark, sf_dir):
    return readers.session_state(tables.ticks(spark, sf_dir)).groupBy("session", "off_hours").agg(F.count(F.lit(1)).alias("n"))


@query("safe_ratio", q.with_(q.BARS) + f"SELECT symbol, ts, {rnd([q.ratio('close', 'open - low') + ' AS close_ratio'])} FROM bars")
def safe_ratio(spark, sf_dir):
    from barloom.functions.cols import ratio
    return tidy(tables.bars(spark, sf_dir).select("symbol", "ts", ratio("close", C("open") - C("low")).alias("close_ratio")))


# --- joins along time -------------------------------------------------------------------


MONTHLY = "monthly AS (SELECT CAST(date_trunc('month', ts) AS DATE) + 14 AS ts, avg(vix) AS vix FROM vix GROUP BY 1)"


def monthly_vix(spark, sf_dir):
    """Mean level of each month, dated at its middle."""
    return (tables.vix(spark, sf_dir).groupBy(F.date_add(F.trunc("ts", "month"), 14).alias("ts")).agg(F.avg("vix").alias("vix")))


@query("asof_vix", q.with_(q.BARS, q.VIX, MONTHLY) + f"""SELECT symbol, ts, {rnd(['coalesce(lv, 15) AS vix'])} FROM bars JOIN (SELECT ts, last_value(v.vix IGNORE NULLS) OVER
 (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lv FROM (SELECT ts FROM bars UNION SELECT ts FROM monthly) LEFT JOIN monthly v USING (ts)) USING (ts)""")
def asof_vix(spark, sf_dir):
    """Latest monthly level at each bar date; 15 before the first."""
    out = joins.asof_calendar(tables.bars(spark, sf_dir).select("symbol", "ts"), monthly_vix(spark, sf_dir), {"vix": 15.0})
    return tidy(out)


@query("lookup_vix", q.with_(q.BARS, q.VIX, MONTHLY) + f"SELECT symbol, ts, {rnd(['coalesce(v.vix, 15) AS vix'])} FROM bars LEFT JOIN monthly v USING (ts)")
def lookup_vix(spark, sf_dir):
    out = tables.bars(spark, sf_dir).select("symbol", "ts").join(monthly_vix(spark, sf_dir), "ts", "left")
    return tidy(out.withColumn("vix", F.coalesce("vix", F.lit(15.0))))


@query("asof_fill_quote", q.with_(q.TICKS) + f"""SELECT event_id, symbol, {rnd(['coalesce(p, -1) AS price'])} FROM (SELECT *, last_value(big IGNORE NULLS) OVER
 (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1 THEN price END AS big FROM ticks))""")
def asof_fill_quote(spark, sf_dir):
    """Last closing quote of an hour of the same symbol at or before each tick; hot symbols are spread over days."""
    t = tables.ticks(spark, sf_dir)
    left = t.select("event_id", "symbol", "ts")
    closes = t.groupBy("symbol", F.date_trunc("hour", "ts")).agg(F.max("ts").alias("ts"), F.max_by("price", F.struct("ts", "event_id")).alias("price"))
    out = joins.asof_join(left, closes.select("symbol", "ts", "price"), ["symbol"], "price", bucket="day", default=-1.0)
    return tidy(out, ["event_id", "symbol", "price"])


@query("next_bar_entry", q.with_(q.BARS) + f"SELECT symbol, ts, lead(ts) OVER w AS next_ts, {rnd(['lead(open) OVER w AS next_open'])} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def next_bar_entry(spark, sf_dir):
    from barloom.operators import trades
    return tidy(trades.next_bar(tables.bars(spark, sf_dir)), ["symbol", "ts", "next_ts", "next_open"])


# --- long intraday series ---------------------------------------------------------------

LONG = """bars AS MATERIALIZED (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, min_by(value, row(ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, max_by(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


@query("long_series_indicators", q.with_(LONG, q.IND) + f"SELECT symbol, ts, {rnd(['ema_fast', 'rsi', 'macd_hist', 'adx', 'obv', 'obv_ema', 'fib_high'])}, supertrend_bull FROM ind")
def long_series_indicators(spark, sf_dir):
    """Minute bars of the tick table cut into parts of bounded length, with the same results."""
    t = tables.ticks(spark, sf_dir)
    parts = longseries.split_series(feeds.candles(t, "1 minute"), rows=2048, bucket="day")
    out = ind.run(parts, [ind.EMA, ind.RSI, ind.MACD, ind.ADX, ind.OBV, ind.OBV_TREND, ind.FIBONACCI, ind.SUPERTREND], ind.CFG)
    out = longseries.merge_series(out).withColumn("ts", C("ts").cast("timestamp_ntz"))
    return tidy(out, ["symbol", "ts", "ema_fast", "rsi", "macd_hist", "adx", "obv", "obv_ema", "fib_high", "supertrend_bull"])


# --- news -------------------------------------------------------------------------------

# A test lexicon of common words, since the texts are invented.
LEXICON = {"with": 0.6, "for": 0.5, "this": 0.4, "are": 0.3, "was": -0.6, "from": -0.5, "at": -0.4, "by": -0.3}
LEX = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', CAST({p} AS DOUBLE))" for w, p in LEXICON.items()) + ") t(word, polarity))"
AS_OF, HOURS = "2024-01-31 00:00:00", 720
CONFIDENCE = 0.0501  # off the grid of short means, where sums in another order would tie
NEWS = q.with_(q.ARTICLES, LEX, f"""words AS (SELECT doc_id, unnest(string_split_regex(lower(title || '. ' || summary), '[^\\p{{L}}]+')) AS word FROM articles),
pol AS (SELECT doc_id, avg(polarity) AS s, count(*) AS h FROM words JOIN lexicon USING (word) GROUP BY 1),
scores AS (SELECT a.*, coalesce(s, 0) AS sentiment, abs(coalesce(s, 0)) AS confidence, coalesce(h, 0) AS hits,
 date_diff('second', published, TIMESTAMP '{AS_OF}') / CAST(3600 AS DOUBLE) AS age FROM articles a LEFT JOIN pol USING (doc_id)),
wt AS (SELECT *, greatest(CAST(0.05 AS DOUBLE), exp(-greatest(0, age) / {HOURS})) AS weight FROM scores
 WHERE published > TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR AND confidence >= {CONFIDENCE})""")
NEWS_LABEL = ("CASE WHEN score >= 70 THEN 'Strongly Bullish' WHEN score >= 58 THEN 'Bullish' WHEN score >= 42 THEN 'Neutral' "
              "WHEN score >= 30 THEN 'Bearish' ELSE 'Strongly Bearish' END")


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")


def polarity(spark, sf_dir):
    return news.polarity(news.prepared(tables.articles(spark, sf_dir)), lexicon(spark))


def weighted(spark, sf_dir):
    fresh = news.recent(polarity(spark, sf_dir), AS_OF, HOURS)
    return news.weighted(fresh, HOURS, CONFIDENCE).withColumn("symbol", C("lang"))


@query("article_polarity", NEWS + f"SELECT doc_id, {rnd(['sentiment', 'confidence'])}, hits FROM scores")
def article_polarity(spark, sf_dir):
    return tidy(polarity(spark, sf_dir), ["doc_id", "sentiment", "confidence", "hits"])


@query("recent_articles", NEWS + f"SELECT doc_id, {rnd(['age AS age_hours'])} FROM scores WHERE published > TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR")
def recent_articles(spark, sf_dir):
    return tidy(news.recent(tables.articles(spark, sf_dir), AS_OF, HOURS), ["doc_id", "age_hours"])


@query("news_sentiment", NEWS + f", syms AS (SELECT DISTINCT lang AS symbol FROM documents UNION ALL SELECT 'none'), agg AS (SELECT lang AS symbol, sum(sentiment * weight) / sum(weight) AS a, count(*) AS n FROM wt GROUP BY 1),"
       f" fin AS (SELECT symbol, coalesce((a + 1) / 2 * 100, 50) AS score, coalesce(n, 0) AS article_count FROM syms LEFT JOIN agg USING (symbol))"
       f" SELECT symbol, {rnd(['score'])}, article_count, {NEWS_LABEL} AS label FROM fin")
def news_sentiment(spark, sf_dir):
    symbols = tables.table(spark, sf_dir, "documents").select(C("lang").alias("symbol")).distinct()
    symbols = symbols.union(spark.createDataFrame([("none",)], "symbol string"))  # a symbol without articles
    return tidy(news.summary(weighted(spark, sf_dir), symbols), ["symbol", "score", "article_count", "label"])


@query("source_breakdown", NEWS + f"SELECT lang AS symbol, source, {rnd(['avg(sentiment) * 50 + 50 AS source_score'])} FROM wt GROUP BY 1, 2")
def source_breakdown(spark, sf_dir):
    return tidy(news.source_breakdown(weighted(spark, sf_dir)), ["symbol", "source", "source_score"])


@query("article_caps", NEWS + "SELECT source, doc_id FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY published DESC, doc_id) <= 15")
def article_caps(spark, sf_dir):
    return news.capped(tables.articles(spark, sf_dir), ["source"], 15).select("source", "doc_id")


@query("source_map", NEWS + f""", parts AS (SELECT lang AS symbol, source, {q.near('avg(sentiment) * 50 + 50', 1)} AS score FROM wt GROUP BY 1, 2)
 SELECT symbol, string_agg(source || '=' || CAST(CAST(score * 10 AS BIGINT) AS VARCHAR), ',' ORDER BY source) AS breakdown FROM parts GROUP BY 1""")
def source_map(spark, sf_dir):
    """Sources and their scores (in tenths) of each symbol."""
    parts = news.source_map(weighted(spark, sf_dir), score=lambda c: near(c, 1))
    entries = F.array_sort(F.map_entries("source_breakdown"))
    return parts.select("symbol", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 10).cast("long"))), ",").alias("breakdown"))


@query("report_articles", NEWS + f""", newest AS (SELECT *, lang AS symbol FROM scores QUALIFY row_number() OVER (PARTITION BY lang ORDER BY published DESC, doc_id) <= 30)
 SELECT symbol, doc_id, {rnd(['sentiment'])}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) AS INTEGER) AS place FROM newest
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) <= 8""")
def report_articles(spark, sf_dir):
    """The eight newest of the thirty articles per symbol that a report scores."""
    named = news.prepared(tables.articles(spark, sf_dir)).withColumn("symbol", C("lang"))
    shown = news.report(news.polarity(news.capped(named, ["symbol"], 30), lexicon(spark)))
    return tidy(shown.select("symbol", F.posexplode("articles").alias("place", "a")).select(
        "symbol", "a.doc_id", "a.sentiment", (C("place") + 1).cast("int").alias("place")))


SECTORS = "keys AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{w}')" for s, ws in news.SECTOR_KEYWORDS.items() for w in ws) + ") t(sector, word))"


@query("sector_tags", q.with_(q.ARTICLES, SECTORS, """body AS (SELECT doc_id, lower(title || '. ' || summary) AS t FROM articles),
 padded AS (SELECT doc_id, ' ' || regexp_replace(t, '[^\\p{L}]+', ' ', 'g') || ' ' AS single, ' ' || regexp_replace(t, '[^\\p{L}-]+', ' ', 'g') || ' ' AS phrase FROM body)""")
       + """SELECT doc_id, sector, count(*) AS keywords FROM padded JOIN keys ON CASE WHEN regexp_matches(word, '^[a-z]+$') THEN contains(single, ' ' || word || ' ')
 ELSE contains(phrase, ' ' || word || ' ') END GROUP BY 1, 2""")
def sector_tags(spark, sf_dir):
    return news.sector_tags(news.prepared(tables.articles(spark, sf_dir)))


@query("article_mentions", q.with_(q.ARTICLES) + """, names AS (SELECT DISTINCT n_name AS symbol FROM nation UNION SELECT DISTINCT lang || 'ltd' FROM documents UNION SELECT 'forIND' UNION SELECT 'withltd'),
 forms AS (SELECT symbol, lower(symbol) AS full_name, replace(replace(lower(symbol), 'ind', ''), 'ltd', '') AS short FROM names)
 SELECT DISTINCT doc_id, symbol FROM (SELECT doc_id, lower(title || '. ' || summary) AS t FROM articles) JOIN forms
 ON contains(t, full_name) OR (length(short) > 3 AND contains(t, short))""")
def article_mentions(spark, sf_dir):
    names = tables.table(spark, sf_dir, "nation").select(C("n_name").alias("symbol"))
    names = names.union(tables.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("ltd"))))
    names = names.union(spark.createDataFrame([("forIND",), ("withltd",)], "symbol string")).distinct()
    return news.mentions(news.prepared(tables.articles(spark, sf_dir)), names)


@query("publication_times", q.with_(q.ARTICLES) + "SELECT doc_id, published FROM articles")
def publication_times(spark, sf_dir):
    """Times written in the three feed formats by turns and parsed again."""
    t = C("published").cast("timestamp")
    text = (F.when(C("doc_id") % 3 == 0, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss Z"))
            .when(C("doc_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssZ"))
            .otherwise(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")))
    rows = tables.articles(spark, sf_dir).select("doc_id", text.alias("published_text"))
    return news.parsed_time(rows).select("doc_id", "published")


# --- ticks ------------------------------------------------------------------------------


@query("candles", q.with_(q.TICKS) + f"""SELECT symbol, date_trunc('hour', ts) AS ts, {rnd(['min_by(price, row(ts, event_id)) AS open', 'max(price) AS high',
 'min(price) AS low', 'max_by(price, row(ts, event_id)) AS close', 'sum(volume) AS volume'])} FROM ticks GROUP BY 1, 2""")
def candles(spark, sf_dir):
    out = feeds.candles(tables.ticks(spark, sf_dir), "1 hour")
    return tidy(out.withColumn("ts", C("ts").cast("timestamp_ntz")))


@query("last_candles", q.with_(q.TICKS) + f"""SELECT symbol, h AS ts, {rnd(['close'])} FROM (SELECT symbol, date_trunc('hour', ts) AS h, max_by(price, row(ts, event_id)) AS close FROM ticks GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY h DESC) <= 390""")
def last_candles(spark, sf_dir):
    out = feeds.last_candles(feeds.candles(tables.ticks(spark, sf_dir), "1 hour"))
    return tidy(out.withColumn("ts", C("ts").cast("timestamp_ntz")), ["symbol", "ts", "close"])


@query("latest_quote", q.with_(q.TICKS) + f"SELECT symbol, {rnd(['max_by(price, row(ts, event_id)) AS price'])}, max(ts) AS ts FROM ticks GROUP BY 1")
def latest_quote(spark, sf_dir):
    return tidy(feeds.latest(tables.ticks(spark, sf_dir)).withColumn("ts", C("ts").cast("timestamp_ntz")))


@query("tick_history", q.with_(q.TICKS) + f"SELECT symbol, event_id, {rnd(['price'])} FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) <= 500")
def tick_history(spark, sf_dir):
    return tidy(feeds.recent_ticks(tables.ticks(spark, sf_dir), 500), ["symbol", "event_id", "price"])


@query("price_changes", q.with_(q.TICKS) + f""", dc AS (SELECT symbol, CAST(ts AS DATE) AS d, max_by(price, row(ts, event_id)) AS c FROM ticks GROUP BY 1, 2),
 pcl AS (SELECT symbol, d, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS prev_close FROM dc)
 SELECT event_id, {rnd(['price - prev_close AS change', '(price / nullif(prev_close, 0) - 1) * 100 AS change_pct'])} FROM ticks t LEFT JOIN pcl ON t.symbol = pcl.symbol AND CAST(t.ts AS DATE) = pcl.d""")
def price_changes(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    return tidy(feeds.changes(t, feeds.previous_closes(t)), ["event_id", "change", "change_pct"])


@query("stop_target_hits", q.with_(q.TICKS, "lv AS (SELECT symbol, avg(price) AS m, stddev_samp(price) AS sd FROM ticks GROUP BY 1)",
       """ps AS (SELECT symbol || '/' || k AS position_id, symbol, CASE WHEN k = 2 THEN 'SHORT' ELSE 'LONG' END AS direction, CASE k WHEN 2 THEN m + 2 * sd ELSE m - (1.5 - k) * sd END AS sl,
 CASE k WHEN 2 THEN m - 1.5 * sd ELSE m + 2 * sd END AS tp FROM lv CROSS JOIN range(3) g(k)),
ht AS (SELECT position_id, symbol, direction, t.ts, t.price, t.event_id, CASE WHEN direction = 'LONG' THEN CASE WHEN price <= sl THEN 'SL_HIT' WHEN price >= tp THEN 'TP_HIT' END
 ELSE CASE WHEN price >= sl THEN 'SL_HIT' WHEN price <= tp THEN 'TP_HIT' END END AS exit_flag FROM ticks t JOIN ps USING (symbol))""")
       + f"SELECT position_id, symbol, direction, ts, {rnd(['price'])}, exit_flag FROM ht WHERE exit_flag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ts, event_id) = 1")
def stop_target_hits(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    out = feeds.first_hits(t, positions(t)).withColumn("ts", C("ts").cast("timestamp_ntz"))
    return tidy(out, ["position_id", "symbol", "direction", "ts", "price", "exit_flag"])


def positions(ticks):
    """Two long positions with different stops and a short one per symbol."""
    lv = ticks.groupBy("symbol").agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("sd"))
    k, low, high = C("k"), C("m") - C("sd") * 1.5, C("m") + C("sd") * 2
    return lv.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.concat_ws("/", "symbol", "k").alias("position_id"), "symbol", F.when(k == 2, "SHORT").otherwise("LONG").alias("direction"),
        F.when(k == 2, high).otherwise(C("m") - (1.5 - k) * C("sd")).alias("stop_loss"), F.when(k == 2, low).otherwise(high).alias("take_profit"))
