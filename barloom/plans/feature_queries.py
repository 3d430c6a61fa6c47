"""Feature, label and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.joins import market_table
from barloom.operators import datasets, features as fe, indicators as ind, labels, options
from barloom.plans.registry import near, query, tidy
from barloom.plans import sql_base as q
from barloom.plans.sql_base import rnd
from barloom.sources import tables

FULL = q.with_(q.BARS, q.IND, q.NEUTRAL, q.FEATURE)
WITH_KALMAN = q.with_(q.BARS, q.IND, q.NEUTRAL, q.FEATURE, q.KALMAN)
MARKET_CTES = (q.BARS, q.VIX, q.CONTRACTS, q.OPTIONS, q.IND, q.MARKET, q.FEATURE)


def market(spark, sf_dir):
    """Volatility and news levels, and put-call ratio, IV rank and max pain of the first index symbol."""
    summary = options.daily_summary(tables.contracts(spark, sf_dir)).filter(F.col("symbol") == tables.INDEX_SYMBOLS[0])
    ranked = options.iv_rank(summary, keep_all=True).select(
        F.col("trade_date").alias("ts"), "pcr", "max_pain", F.col("iv_rank").alias("iv_rank_level"))
    return market_table(tables.vix(spark, sf_dir), ranked, tables.sentiment(spark, sf_dir))


# name -> (feature columns, families, base families)
FAMILIES = {
    "price_ratios": (["close_to_ema_fast", "close_to_ema_slow", "close_to_sma200", "close_to_bb_upper", "close_to_bb_lower",
                      "close_to_vwap"], [fe.TREND_STATE], ind.ALL),
    "yearly_extremes": (["close_to_52w_high", "close_to_52w_low", "high_low_range"], [fe.RANGES], []),
    "returns": (["ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "roc_5d", "roc_20d"], [fe.RETURNS], []),
    "realized_volatility": (["realized_vol_5d", "realized_vol_20d", "vol_regime"], [fe.RETURNS, fe.VOLATILITY], []),
    "atr_ratios": (["atr_ratio", "atr_norm_ret_5d"], [fe.RETURNS, fe.ATR_RATIOS], [ind.ATR]),
    "candle_shape": (["body_ratio", "upper_wick", "lower_wick", "candle_direction", "close_loc", "spread_pressure"],
                     [fe.CANDLES], []),
    "oscillator_features": (["rsi", "rsi_divergence", "macd_hist", "macd_hist_accel", "stochrsi_k", "williams_r", "cci"],
                            [fe.OSCILLATORS], [ind.RSI, ind.STOCH_RSI, ind.MACD, ind.WILLIAMS, ind.CCI]),
    "volume_features": (["vol_ratio", "vol_price_trend", "cmf_20", "inst_participation", "amihud_illiquidity", "volume_clock"],
                        [fe.RETURNS, fe.GAPS, fe.VOLUME], []),
    "trend_state": (["ema_cross", "above_sma200", "above_vwap", "adx", "supertrend_bull", "above_cloud", "obv_rising",
                     "bb_width", "bb_pct", "bb_squeeze", "regime_trending"], [fe.TREND_STATE], ind.ALL),
    "hull_slope": (["hma_slope"], [fe.HULL], []),
    "edge_smoothers": (["sg_momentum_5d", "sg_momentum_10d", "sg_accel"], [fe.EDGE], []),
    "force_index": (["force_index_5d"], [fe.FORCE], []),
    "parkinson_volatility": (["parkinson_vol_10d", "vol_expansion", "vol_adjusted_mom"],
                             [fe.RETURNS, fe.VOLATILITY, fe.PARKINSON], []),
    "volume_weighted_macd": (["vwmacd_hist"], [fe.VWMACD], []),
    "trend_line": (["linreg_slope_norm", "linreg_r2", "momentum_quality"], [fe.RETURNS, fe.TREND_LINE], []),
    "opening_gaps": (["gap_pct", "gap_5d_persistence"], [fe.GAPS], []),
    "hurst_exponent": (["hurst_exponent_20"], [fe.HURST], []),
    "trend_efficiency": (["trend_efficiency"], [fe.RETURNS, fe.EFFICIENCY], []),
    "liquidity_sweep": (["liquidity_sweep"], [fe.RETURNS, fe.GAPS, fe.VOLUME, fe.SWEEP], []),
}


def _register(name, columns, families, base):
    @query(name, FULL + f"SELECT symbol, ts, {rnd(columns)} FROM fea")
    def run(spark, sf_dir):
        out = fe.only(tables.bars(spark, sf_dir), *families, base=base)
        return tidy(out.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in columns]))


for _n, (_c, _f, _b) in FAMILIES.items():
    _register(_n, _c, _f, _b)

MARKET_COLUMNS = ["pcr_5d", "iv_rank", "max_pain_dist", "news_sentiment_1d", "news_sentiment_5d", "news_momentum",
                  "vix_level", "vix_change_5d", "vix_percentile"]


@query("market_features", q.with_(*MARKET_CTES) + f"SELECT symbol, ts, {rnd(MARKET_COLUMNS)} FROM fea")
def market_features(spark, sf_dir):
    bars = fe.with_market(tables.bars(spark, sf_dir), market(spark, sf_dir))
    return tidy(fe.only(bars, fe.MARKET).select("symbol", "ts", *MARKET_COLUMNS))


@query("rolling_zscore", FULL + f"SELECT symbol, ts, {rnd(['zscore'])} FROM f1")
def rolling_zscore(spark, sf_dir):
    return tidy(fe.zscore(tables.bars(spark, sf_dir)), ["symbol", "ts", "zscore"])


K = ["kalman_trend", "kalman_velocity", "noise_ratio"]


@query("kalman_trend", WITH_KALMAN + f"SELECT symbol, ts, {rnd(K)} FROM kaf JOIN f1 USING (symbol, rn)")
def kalman_trend(spark, sf_dir):
    return tidy(fe.only(tables.bars(spark, sf_dir), fe.KALMAN), ["symbol", "ts", *K])


def _epilogue(c: str) -> str:
    filled = q.past(c) if c in fe.NULLABLE else c
    return f"{q.clip(q.fill(filled, 0), -10, 10)} AS {c}"


MATRIX_SQL = (q.with_(*MARKET_CTES, q.KALMAN)
              + f"SELECT symbol, ts, {rnd(fe.FEATURES)} FROM (SELECT symbol, ts, {', '.join(_epilogue(c) for c in fe.FEATURES)} "
              + "FROM fea JOIN kaf USING (symbol, rn))")


@query("feature_matrix", MATRIX_SQL)
def feature_matrix(spark, sf_dir):
    """All 80 columns after the epilogue, with market series as of each date."""
    return tidy(fe.features(tables.bars(spark, sf_dir), market(spark, sf_dir)), ["symbol", "ts", *fe.FEATURES])


# --- labels -----------------------------------------------------------------------------

LABELS = f"""l0 AS (SELECT *, greatest(atr, close * 0.005) AS fa, {q.lead('close', 10)} AS e10, {q.lead('close', 5)} AS e5, {q.lead('close', 11)} AS e11,
 {q.frame('max(volume)', 1, 10)} AS peak, {q.roll('avg', 'volume', 20, 5)} AS usual, {q.div('close', 'pc')} - 1 AS ret FROM ind),
quality AS (SELECT symbol, ts, {q.flag('e11 IS NOT NULL AND (e10 - close) / close / (fa / close) > 0.30 AND e5 > close * 0.998 AND peak > CASE WHEN usual > 0 THEN usual ELSE 1e-8 END * 1.1')} AS label FROM l0),
hits AS (SELECT a.symbol, a.rn, min(CASE WHEN b.high >= a.close + 2 * a.fa THEN b.rn END) AS up, min(CASE WHEN b.low <= a.close - a.fa THEN b.rn END) AS dn
 FROM l0 a CROSS JOIN range(1, 11) o(k) JOIN l0 b ON b.symbol = a.symbol AND b.rn = a.rn + o.k GROUP BY 1, 2),
barrier AS (SELECT symbol, ts, {q.flag("e10 IS NOT NULL AND CASE WHEN up IS NULL AND dn IS NULL THEN e10 > close ELSE coalesce(up, 999999999) <= coalesce(dn, 999999999) END")} AS label
 FROM l0 LEFT JOIN hits USING (symbol, rn)),
sharpe AS (SELECT symbol, ts, CASE WHEN e5 IS NULL THEN 0 ELSE least(greatest((m - CAST(0.065 AS DOUBLE) / 252) / greatest(sd, CAST(1e-8 AS DOUBLE)) * sqrt(252), -5), 5) END AS target
 FROM (SELECT *, {q.frame('avg(ret)', 1, 5)} AS m, {q.frame('stddev_pop(ret)', 1, 5)} AS sd FROM l0))"""
LABEL_SQL = q.with_(q.BARS, q.IND, LABELS)


def with_atr(spark, sf_dir):
    return ind.atr(tables.bars(spark, sf_dir))


@query("trend_quality_label", LABEL_SQL + "SELECT symbol, ts, label FROM quality")
def trend_quality_label(spark, sf_dir):
    return labels.trend_quality(with_atr(spark, sf_dir)).select("symbol", "ts", "label")


@query("triple_barrier_label", LABEL_SQL + "SELECT symbol, ts, label FROM barrier")
def triple_barrier_label(spark, sf_dir):
    return labels.triple_barrier(with_atr(spark, sf_dir)).select("symbol", "ts", "label")


@query("forward_sharpe", LABEL_SQL + f"SELECT symbol, ts, {rnd(['target'])} FROM sharpe")
def forward_sharpe(spark, sf_dir):
    return tidy(labels.sharpe_target(tables.bars(spark, sf_dir)), ["symbol", "ts", "target"])


@query("positive_rate", LABEL_SQL + f"SELECT symbol, {rnd(['avg(label) AS rate'])}, count(*) AS n FROM quality GROUP BY 1")
def positive_rate(spark, sf_dir):
    return tidy(labels.positive_rates(trend_quality_label(spark, sf_dir)))


@query("mean_positive_rate", LABEL_SQL + f"SELECT {rnd(['avg(rate) AS mean_rate'])}, count(*) AS symbols FROM "
       "(SELECT symbol, avg(label) AS rate FROM quality GROUP BY 1)")
def mean_positive_rate(spark, sf_dir):
    return tidy(labels.mean_positive_rate(trend_quality_label(spark, sf_dir)))


# --- datasets ---------------------------------------------------------------------------

FOLDS = """cal AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
folds AS (SELECT f AS fold, n // 6 * (f + 1) AS e, n // 6 * (f + 1) + 10 AS s, n // 6 * (f + 2) + 10 AS t, n
 FROM (SELECT DISTINCT n FROM cal), range(4) g(f) WHERE n // 6 * (f + 2) + 10 <= n),
bounds AS MATERIALIZED (SELECT CAST(fold AS INTEGER) AS fold, (SELECT ts FROM cal WHERE i = e) AS train_cutoff, (SELECT ts FROM cal WHERE i = s) AS test_start,
 (SELECT ts FROM cal WHERE i = least(t, n - 1)) AS test_end FROM folds),
assigned AS (SELECT symbol, ts, fold, 'train' AS side FROM bars JOIN bounds ON ts <= train_cutoff
 UNION ALL SELECT symbol, ts, fold, 'test' FROM bars JOIN bounds ON ts BETWEEN test_start AND test_end),
kept AS (SELECT * FROM assigned QUALIFY count(*) OVER (PARTITION BY symbol, fold, side) > 20)"""


@query("walk_forward_folds", q.with_(q.BARS, FOLDS) + "SELECT * FROM bounds")
def walk_forward_folds(spark, sf_dir):
    return datasets.folds(tables.bars(spark, sf_dir))


@query("fold_assignment", q.with_(q.BARS, FOLDS) + "SELECT symbol, fold, side, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts "
       "FROM kept GROUP BY ALL")
def fold_assignment(spark, sf_dir):
    rows = datasets.assign(tables.bars(spark, sf_dir))
    return rows.groupBy("symbol", "fold", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


SPLIT = """days AS (SELECT ts, count(*) AS c FROM bars GROUP BY 1),
parts AS (SELECT ts, CASE WHEN s <= 0.70 THEN 'train' WHEN s <= 0.85 THEN 'valid' ELSE 'test' END AS part
 FROM (SELECT ts, CAST(sum(c) OVER (ORDER BY ts) AS DOUBLE) / sum(c) OVER () AS s FROM days))"""


@query("chronological_split", q.with_(q.BARS, SPLIT) + "SELECT part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts "
       "FROM bars JOIN parts USING (ts) GROUP BY 1")
def chronological_split(spark, sf_dir):
    out = datasets.chronological_split(tables.bars(spark, sf_dir))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("class_weight", LABEL_SQL + "SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, "
       f"{rnd(['CAST(count(*) FILTER (label = 0) AS DOUBLE) / greatest(1, count(*) FILTER (label = 1)) AS weight'])} FROM quality")
def class_weight(spark, sf_dir):
    return tidy(datasets.class_weights(trend_quality_label(spark, sf_dir)))


SEQ = """seq AS (SELECT a.symbol, a.ts, any_value(a.close) AS label, count(*) AS n, sum(b.close * (30 - o.k)) / 1000 AS digest, min(b.ts) AS first_ts
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) a CROSS JOIN range(30) o(k)
 JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) b ON b.symbol = a.symbol AND b.rn = a.rn - o.k
 WHERE a.rn > 30 AND (a.rn - 31) % 5 = 0 GROUP BY 1, 2)"""


@query("sliding_sequences", q.with_(q.BARS, SEQ) + f"SELECT symbol, ts, {rnd(['digest', 'label'], 2)}, n FROM seq")
def sliding_sequences(spark, sf_dir):
    """Every fifth 30-row sequence of each symbol, shown by a position-weighted digest."""
    out = datasets.sequences(tables.bars(spark, sf_dir), ["close"], 30, 5, label="close")
    digest = F.aggregate(F.transform("sequence", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda a, x: a + x) / 1000
    return tidy(out.select("symbol", "ts", digest.alias("digest"), F.col("close").alias("label"),
                           F.size("sequence").cast("bigint").alias("n")), digits=2)


@query("sequence_sampling", q.with_(q.BARS) + """SELECT symbol, available, CAST(greatest(5, floor(available * 5000 / t)) AS BIGINT) AS take,
 CAST(greatest(1, floor(available / greatest(5, floor(available * 5000 / t)))) AS BIGINT) AS step FROM
 (SELECT symbol, available, CAST(greatest(1, sum(available) OVER ()) AS DOUBLE) AS t FROM
 (SELECT symbol, greatest(0, count(*) - 30) AS available FROM bars GROUP BY 1 HAVING count(*) >= 35))""")
def sequence_sampling(spark, sf_dir):
    return datasets.sequence_stride(tables.bars(spark, sf_dir), 5000)


STEPS = """steps AS (SELECT symbol, CAST(greatest(5, floor(available * 2000 / t)) AS BIGINT) AS take, CAST(greatest(1, floor(available / greatest(5, floor(available * 2000 / t)))) AS BIGINT) AS step FROM
 (SELECT symbol, available, CAST(greatest(1, sum(available) OVER ()) AS DOUBLE) AS t FROM (SELECT symbol, greatest(0, count(*) - 30) AS available FROM bars GROUP BY 1 HAVING count(*) >= 35))),
sq AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 31 AS i, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS seq FROM bars)"""


@query("sampled_sequences", q.with_(q.BARS, STEPS) + f"""SELECT symbol, ts, {rnd(['list_sum(list_transform(range(1, 31), lambda j: seq[j] * j)) / 1000 AS digest', 'close AS label'], 2)} FROM sq JOIN steps USING (symbol)
 WHERE i >= 0 AND i % step = 0 AND i / CAST(step AS DOUBLE) < take""")
def sampled_sequences(spark, sf_dir):
    """Sequences at the proportional step of each symbol, up to its share of 2,000."""
    out = datasets.sampled_sequences(tables.bars(spark, sf_dir), ["close"], 2000, 30, label="close")
    digest = F.aggregate(F.transform("sequence", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda a, x: a + x) / 1000
    return tidy(out.select("symbol", "ts", digest.alias("digest"), F.col("close").alias("label")), digits=2)


@query("sequence_split", q.with_(q.BARS, """days AS (SELECT ts, count(*) AS c FROM bars GROUP BY 1),
 cut AS (SELECT min(ts) AS cutoff FROM (SELECT ts, CAST(sum(c) OVER (ORDER BY ts) AS DOUBLE) / sum(c) OVER () AS s FROM days) WHERE s > 0.85),
 sides AS (SELECT symbol, ts, CASE WHEN ts < cutoff THEN 'train' ELSE 'test' END AS part FROM bars, cut)""")
       + """SELECT symbol, part, count(*) AS n FROM sides WHERE symbol IN (SELECT symbol FROM sides GROUP BY 1
 HAVING count(*) FILTER (part = 'train') >= 30 AND count(*) FILTER (part = 'test') >= 10) GROUP BY 1, 2""")
def sequence_split(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    out = datasets.sequence_split(bars, datasets.cutoff_date(bars))
    return out.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("complete_rows", q.with_(q.BARS, q.IND) + "SELECT symbol, count(*) AS n FROM ind "
       "WHERE sma200 IS NOT NULL AND rsi IS NOT NULL AND bb_pct IS NOT NULL GROUP BY 1")
def complete_rows(spark, sf_dir):
    out = ind.run(tables.bars(spark, sf_dir), [ind.SMA, ind.RSI, ind.BOLLINGER], ind.CFG)
    return datasets.complete(out, ["sma200", "rsi", "bb_pct"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
