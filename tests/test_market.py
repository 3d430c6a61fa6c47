"""Options, risk, trades, models and streams."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models, news, options, risk, scoring, trades
from barloom.sources import readers, tables
from barloom.streaming import feeds

DIR = "/root/testdata/sf0.001"


def test_implied_volatility_inverts_price(spark):
    rows = [(100.0, k, 0.25, 0.065, v, t) for k in (90.0, 100.0, 110.0) for v in (0.15, 0.4) for t in ("CE", "PE")]
    df = spark.createDataFrame(rows, "spot double, strike double, years double, rate double, sigma double, option_type string")
    out = options.implied_vol(options.price(df).withColumn("market_price", F.col("bs_price"))).toPandas()
    intrinsic = np.maximum(0, np.where(out["option_type"] == "CE", out["spot"] - out["strike"], out["strike"] - out["spot"]))
    below = out["bs_price"] < intrinsic  # a discounted put may be worth less than its intrinsic value
    assert below.sum() == 1 and (out["iv"][below] == 0).all()
    assert np.allclose(out["iv"][~below], out["sigma"][~below], atol=2e-3)
    low = df.limit(1).withColumn("market_price", F.lit(0.0))
    assert options.implied_vol(low).first()["iv"] == 0.0
    dead = options.greeks(options.price(df.withColumn("years", F.lit(0.0)))).toPandas()
    assert (dead["delta"] == 0).all() and dead["bs_price"].max() == 10.0


def test_signal_edges(spark):
    probs = [0.68, 0.55, 0.5, 0.45, 0.32]
    df = scoring.model_signal(spark.createDataFrame([(p,) for p in probs], "prob double"))
    assert [r["model_signal"] for r in df.collect()] == ["STRONG BUY", "BUY", "HOLD", "SELL", "STRONG SELL"]


def test_short_pnl_sign(spark):
    df = spark.createDataFrame([("SHORT", 10, 100.0, 90.0), ("LONG", 10, 100.0, 90.0)],
                               "direction string, quantity int, entry_price double, exit_price double")
    short, long = trades.pnl(df).collect()
    assert short["gross_pnl"] == 100 and long["gross_pnl"] == -100 and short["net_pnl"] < 100


def test_running_before_any_block_width(spark):
    fills = tables.fills(spark, DIR)
    a = risk.running_before(fills, {"n": "1", "p": "pnl"}, 16).orderBy("fill_id").toPandas()
    b = risk.running_before(fills, {"n": "1", "p": "pnl"}, 10**9).orderBy("fill_id").toPandas()
    assert (a["n"] == b["n"]).all() and np.allclose(a["p"].astype(float), b["p"].astype(float))


def test_drawdown_is_carried(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(i, "A", start + datetime.timedelta(days=i), 1000.0, 90.0, 90.0, -20000.0) for i in range(10)]
    fills = spark.createDataFrame(rows, "fill_id long, symbol string, ts date, trade_value double, ml_confidence double, tech_score double, pnl double")
    verdict = [r["verdict"] for r in risk.verdicts(fills).orderBy("fill_id").collect()]
    assert verdict[0] == "APPROVED" and verdict[9] == "DRAWDOWN"


def test_candle_stream_equals_batch(spark, tmp_path):
    batch = tables.ticks(spark, DIR)
    batch.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ticks"))
    q = (feeds.candles(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("candles_out")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    key = ["symbol", "ts"]
    got = spark.table("candles_out").toPandas().sort_values(key).reset_index(drop=True)
    want = feeds.candles(batch, "1 hour").toPandas().sort_values(key).reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_contract_csv_and_bars_round_trip(spark, tmp_path):
    (tmp_path / "fo_20240105.csv").write_text(
        " instrument,SYMBOL,EXPIRY_DT,STRIKE_PR,OPTION_TYP,OPEN_INT,CHG_IN_OI,CLOSE,SETTLE_PR,CONTRACTS\n"
        'OPTIDX,AAA,25-Jan-2024,"1,000",CE,"2,500",10,5.5,6.5,7\nOPTIDX,AAA,25-Jan-2024,"1,000",CE,"2,600",,5.5,6.5,7\n'
        "OPTIDX,AAA,25-Jan-2024,x,CE,1,1,1,1,1\nOPTSTK,AAA,25-Jan-2024,900,CE,1,1,1,1,1\n")
    out = readers.read_contracts(spark, str(tmp_path / "*.csv"), ("AAA",)).collect()
    assert len(out) == 1 and out[0]["open_int"] == 2600 and str(out[0]["trade_date"]) == "2024-01-05"
    bars = tables.bars(spark, DIR).withColumn("close_raw", F.col("close"))
    readers.write_bars(bars, str(tmp_path / "bars"))
    assert readers.read_bars(spark, str(tmp_path / "bars")).count() == bars.count()


def test_auc_matches_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(float(round(p, 2)), int(y)) for p, y in zip(rng.random(200), rng.integers(0, 2, 200))]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert models.auc(spark.createDataFrame(rows, "prob double, label int")).first()["auc"] == pytest.approx(want)


def test_two_positions_of_one_side(spark):
    """Each is hit by its own levels, at its own tick."""
    rows = [("A", f"2024-01-01 0{h}:{m}0:00", p, h * 10 + m) for h, m, p in ((1, 0, 100.0), (1, 3, 84.0), (2, 1, 90.0), (3, 0, 74.0), (3, 2, 60.0))]
    ticks = spark.createDataFrame(rows, "symbol string, at string, price double, event_id long").withColumn("ts", F.to_timestamp("at"))
    held = spark.createDataFrame([("p1", "A", "LONG", 85.0, 200.0), ("p2", "A", "LONG", 75.0, 200.0), ("p3", "A", "SHORT", 200.0, 65.0)],
                                 "position_id string, symbol string, direction string, stop_loss double, take_profit double")
    got = {r.position_id: (r.price, r.exit_flag) for r in feeds.first_hits(ticks, held).collect()}
    assert got == {"p1": (84.0, "SL_HIT"), "p2": (74.0, "SL_HIT"), "p3": (60.0, "TP_HIT")}


def test_marks_see_quotes_since_entry_alone(spark):
    """An extreme before the entry does not raise the stop; one on the entry's day or later does."""
    rows = [("A", "2024-01-01 10:00:00", 300.0, 1), ("A", "2024-01-02 09:00:00", 250.0, 2), ("A", "2024-01-02 15:00:00", 110.0, 3), ("A", "2024-01-05 09:00:00", 104.0, 4)]
    quotes = spark.createDataFrame(rows, "symbol string, at string, price double, event_id long").withColumn("ts", F.to_timestamp("at"))
    held = spark.createDataFrame([(i, "A", "LONG", 1, 100.0, at, 90.0, 500.0) for i, at in enumerate(
        ("2024-01-02 12:00:00", "2024-01-03 00:00:00", "2023-12-31 00:00:00", "2024-02-01 00:00:00"))],
        "id int, symbol string, direction string, quantity int, entry_price double, at string, stop_loss double, take_profit double")
    held = held.withColumn("entry_ts", F.to_timestamp("at")).drop("at")
    got = {r.id: round(r.trailing_stop, 6) for r in trades.mark(held, quotes).collect()}
    assert got == {0: 108.35, 1: 102.44, 2: 295.5, 3: 90.0}


def test_two_bars_of_a_day_are_refused(spark, make_bars):
    bars = make_bars({"A": [100.0] * 5}).withColumns({"atr": F.lit(1.0), "tech_score": F.lit(70.0), "stop_loss": F.lit(90.0), "take_profit": F.lit(120.0),
                                                      "is_signal": F.lit(True)})
    assert trades.outcomes(bars).count() == 4
    with pytest.raises(Exception, match="one bar per symbol and day"):
        trades.outcomes(bars.union(bars)).collect()


def test_fractions_of_an_hour(spark):
    rows = spark.createDataFrame([(1, "2024-01-30 23:20:00")], "doc_id long, at string").withColumn("published", F.to_timestamp("at"))
    assert news.recent(rows, "2024-01-31 00:00:00", 0.9).count() == 1
    assert news.recent(rows, "2024-01-31 00:00:00", 0.5).count() == 0


def test_relevance_is_what_mentions_find(spark):
    """The predicate on all pairs of a small table against the join."""
    texts = ["Infosys rose", "the infoline", "withltd", "forum", "nothing", "shares of FOR", ""]
    names = ["INFOSYSLTD", "withIND", "FOR", "zzz"]
    articles = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    symbols = spark.createDataFrame([(n,) for n in names], "symbol string")
    pairs = articles.crossJoin(symbols).filter(news.is_relevant(F.col("text"), F.col("symbol"))).select("doc_id", "symbol")
    assert sorted(map(tuple, news.mentions(articles, symbols).collect())) == sorted(map(tuple, pairs.collect()))


def test_files(spark, tmp_path):
    """Bars by year with pruned folders, days that replace themselves, reports and models read back."""
    days = [datetime.date(y, 6, d) for y in (2019, 2020, 2021) for d in (1, 2)]
    bars = spark.createDataFrame([("A", d, 1.0, 2.0, 0.5, 1.5, 10.0, 1.5) for d in days], readers.BARS)
    readers.write_bars(bars, str(tmp_path / "bars"))
    some = readers.read_bars(spark, str(tmp_path / "bars"), "2020-01-01", "2020-06-01")
    assert [r.ts for r in some.collect()] == [datetime.date(2020, 6, 1)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    daily = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, n int")
    readers.append_days(daily, str(tmp_path / "days"))
    readers.append_days(daily.limit(1).withColumn("n", F.lit(99)), str(tmp_path / "days"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 2, 3, 4, 5, 99]
    readers.write_report(str(tmp_path / "report"), daily, daily, daily, daily)
    assert spark.read.parquet(str(tmp_path / "report" / "summary")).count() == 6
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "a double, b double, label int")
    model = models.fit(rows, ["a", "b"], models.ModelConfig(trees=3, depth=2, rounds=2, boost_depth=2))
    models.save(model, str(tmp_path / "model"))
    one, two = (models.score(m, rows).select("forest_prob", "boost_prob").collect() for m in (model, models.load(str(tmp_path / "model"))))
    assert one == two


def test_candles_of_a_stream_with_late_and_repeated_ticks(spark, tmp_path):
    """Append mode: candles come out once the watermark has passed; later ticks are dropped."""
    def put(name, rows):
        df = spark.createDataFrame([("A", t, p, 1.0, e) for t, p, e in rows], "symbol string, at string, price double, volume double, event_id long")
        df.select("symbol", F.to_timestamp("at").alias("ts"), "price", "volume", "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (feeds.candles(spark.readStream.schema("symbol string, ts timestamp, price double, volume double, event_id long").parquet(str(tmp_path / "in")))
             .writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination(120)
        return name

    put("first", [("2024-01-01 10:00:10", 5.0, 1), ("2024-01-01 10:00:50", 7.0, 2), ("2024-01-01 10:00:50", 7.0, 2), ("2024-01-01 10:09:00", 9.0, 3)])
    put("late", [("2024-01-01 10:00:20", 1.0, 4), ("2024-01-01 10:20:00", 4.0, 5)])
    got = sorted((str(r.ts), r.open, r.close, r.low, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 10:00:00", 5.0, 7.0, 5.0, 3.0), ("2024-01-01 10:09:00", 9.0, 9.0, 9.0, 1.0)]
