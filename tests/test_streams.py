"""Streams with state: restarts, late and repeated ticks, against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import tables
from barloom.streaming import books, feeds

DIR = "/root/testdata/sf0.001"
TICK = "symbol string, ts timestamp, price double, volume double, event_id long"
END = datetime.datetime(2030, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file of ticks and runs the stream on what is new, from its checkpoint."""
    def run(rows, build, mode="append", sink=None):
        df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, TICK)
        df.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "volume", "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TICK).parquet(str(tmp_path / "in"))
        w = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q = w.foreachBatch(sink).start() if sink else w.format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out")) if not sink else None
    return run


def tick(symbol, minute, price, event):
    return symbol, datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute), float(price), 1.0, event


def held_of(spark):
    rows = [("a1", "A", "LONG", 95.0, 110.0), ("a2", "A", "LONG", 97.0, 103.0), ("a3", "A", "SHORT", 103.0, 96.0), ("b1", "B", "SHORT", 55.0, 40.0), ("b2", "B", "LONG", 50.0, 50.0)]
    return spark.createDataFrame(rows, "position_id string, symbol string, direction string, stop_loss double, take_profit double")


def test_level_book_restarts_and_takes_late_ticks(spark, feed):
    held = held_of(spark)
    first = [tick("A", 0, 100, 1), tick("A", 2, 104, 2), tick("B", 2, 50, 3), tick("B", 2, 50, 3)]
    second = [tick("A", 1, 96, 4), tick("A", 3, 94, 5), tick("A", 3, 111, 6), tick("C", 4, 1, 7)]  # the first is late, within the watermark
    third = [tick("A", 4, 94, 8), ("C", END, 1.0, 1.0, 9)]
    out = None
    for part in (first, second, third, [("C", END + datetime.timedelta(days=1), 1.0, 1.0, 10)]):
        out = feed(part, lambda s: books.monitor(s, held))
    got = sorted((r.position_id, r.direction, str(r.ts), r.price, r.exit_flag) for r in out.collect())
    batch = spark.createDataFrame(first + second + third, TICK)
    want = sorted((r.position_id, r.direction, str(r.ts), r.price, r.exit_flag) for r in feeds.first_hits(batch, held).collect())
    assert got == want and {g[0] for g in got} == {"a1", "a2", "a3", "b2"}
    assert dict((g[0], g[3]) for g in got) == {"a1": 94.0, "a2": 96.0, "a3": 96.0, "b2": 50.0}


def test_level_book_on_the_table(spark, feed):
    batch = tables.ticks(spark, DIR)
    stats = batch.groupBy("symbol").agg(F.avg("price").alias("m"))
    held = stats.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (5, 10, 20, 500)]))).select(
        F.concat_ws("/", "symbol", "k").alias("position_id"), "symbol", F.when(F.col("k") == 10, "SHORT").otherwise("LONG").alias("direction"),
        (F.col("m") - F.when(F.col("k") == 10, -F.col("k")).otherwise(F.col("k"))).alias("stop_loss"),
        (F.col("m") + F.when(F.col("k") == 10, -2 * F.col("k")).otherwise(2 * F.col("k"))).alias("take_profit")).cache()
    feed(batch, lambda s: books.monitor(s, held))
    out = feed([("-", END, 1.0, 1.0, 1)], lambda s: books.monitor(s, held))
    got = sorted((r.position_id, r.exit_flag, r.price) for r in out.collect())
    assert got == sorted((r.position_id, r.exit_flag, r.price) for r in feeds.first_hits(batch, held).collect())
    assert len(got) >= 2 * stats.count()


def test_tick_ring(spark, feed):
    """Order by event time, repeated ticks once, the oldest leave; the ring survives a restart and is forgotten when idle."""
    seen = []

    def sink(batch, _):
        seen.extend((r.symbol, [t.event_id for t in r.ticks]) for r in batch.collect())

    def build(s):
        return books.tick_rings(s, size=3, idle=3_600_000)

    feed([tick("A", 2, 1, 1), tick("A", 1, 2, 2), tick("A", 2, 1, 1), tick("B", 1, 1, 3)], build, "update", sink)
    assert sorted(seen) == [("A", [2, 1]), ("B", [3])]
    feed([tick("A", 0, 5, 4), tick("A", 3, 5, 5)], build, "update", sink)
    assert seen[-1] == ("A", [2, 1, 5])
    want = feeds.recent_ticks(spark.createDataFrame([tick("A", 2, 1, 1), tick("A", 1, 2, 2), tick("A", 0, 5, 4), tick("A", 3, 5, 5)], TICK), 3)
    assert sorted(r.event_id for r in want.collect()) == sorted(seen[-1][1])
    feed([tick("C", 300, 1, 6)], build, "update", sink)
    feed([tick("C", 301, 1, 7), tick("A", 302, 1, 8)], build, "update", sink)
    assert ("A", [8]) in seen  # five hours without a tick


def test_latest_quotes_survive_restarts(spark, feed, tmp_path):
    t = tables.ticks(spark, DIR)
    path = str(tmp_path / "quotes")
    for part in (0, 1):
        feed(t.filter(F.col("event_id") % 2 == part), feeds.latest, "complete", feeds.write_latest(path))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, feeds.latest(t.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_readings_append(spark, tmp_path):
    """A batch that is repeated replaces itself."""
    chain = '{"records": {"underlyingValue": 100, "expiryDates": ["25-Jan-2024"], "data": [{"expiryDate": "25-Jan-2024", "strikePrice": 100, "CE": {"openInterest": 4}, "PE": {"openInterest": 6}}]}}'
    batch = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1, 10, m), chain) for m in range(3)], "symbol string, ts timestamp, payload string")
    write = feeds.append_readings(str(tmp_path / "history"))
    write(batch.filter("minute(ts) < 2"), 0)
    write(batch.filter("minute(ts) < 2"), 0)
    write(batch.filter("minute(ts) = 2"), 1)
    assert sorted((r.symbol, r.ts.minute, r.pcr) for r in spark.read.parquet(str(tmp_path / "history")).collect()) == [("A", m, 1.5) for m in range(3)]
