"""Streaming operators over tick and chain streams, with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import div
from barloom.sources.readers import flatten_chain

C = F.col


def candles(ticks: DataFrame, size: str = "1 minute", watermark: str | None = "5 minutes") -> DataFrame:
    """Tumbling OHLCV bars by event time. Works on streams and tables; ties broken by event_id.

    A hot symbol is combined map-side before the exchange; ticks later than the watermark are dropped.
    """
    df = ticks.withWatermark("ts", watermark) if watermark and ticks.isStreaming else ticks
    at = F.struct("ts", "event_id")
    out = df.groupBy(F.window("ts", size).alias("_w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", C("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def last_candles(bars: DataFrame, n: int = 390) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(w)).filter(C("_r") <= n).drop("_r")


def recent_ticks(ticks: DataFrame, n: int = 5000) -> DataFrame:
    """Last n ticks per symbol; the rank limit cuts every partition before the exchange."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id"))
    return ticks.withColumn("_r", F.row_number().over(w)).filter(C("_r") <= n).drop("_r")


def latest(ticks: DataFrame) -> DataFrame:
    """Latest quote per symbol; on a stream use complete or update mode (the state is a row per symbol)."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol").agg(F.max_by("price", at).alias("price"), F.max("ts").alias("ts"))


def changes(ticks: DataFrame, closes: DataFrame) -> DataFrame:
    """Change and percent change of each tick against the previous daily close (stream-static join)."""
    out = ticks.withColumn("_d", F.to_date("ts")).join(
        closes.select("symbol", C("ts").alias("_d"), "prev_close"), ["symbol", "_d"], "left").drop("_d")
    return out.withColumns({"change": C("price") - C("prev_close"),
                            "change_pct": (div("price", "prev_close") - 1) * 100})


def previous_closes(ticks: DataFrame) -> DataFrame:
    """(symbol, ts, prev_close): last price of the previous day with ticks."""
    at = F.struct("ts", "event_id")
    daily = ticks.groupBy("symbol", F.to_date("ts").alias("_d")).agg(F.max_by("price", at).alias("_c"))
    w = Window.partitionBy("symbol").orderBy("_d")
    return daily.select("symbol", C("_d").alias("ts"), F.lag("_c").over(w).alias("prev_close"))


def level_hits(ticks: DataFrame, positions: DataFrame, on: str | list[str] = "symbol") -> DataFrame:
    """Ticks that meet the stop or target of an open position (stream-static join, no state)."""
    out = ticks.join(positions, on)
    long, p = C("direction") == "LONG", C("price")
    hit = (F.when(F.when(long, p <= C("stop_loss")).otherwise(p >= C("stop_loss")), "SL_HIT")
           .when(F.when(long, p >= C("take_profit")).otherwise(p <= C("take_profit")), "TP_HIT"))
    return out.withColumn("exit_flag", hit).filter("exit_flag is not null")


def first_hits(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """The first hit of each position (position_id) in a table of ticks.

    Ticks are first reduced to their extremes per symbol and hour; a position meets the hours,
    and only the ticks of its first hour with a hit.
    """
    hour = F.date_trunc("hour", "ts").alias("_hour")
    hours = ticks.groupBy("symbol", hour).agg(F.min("price").alias("_l"), F.max("price").alias("_h"))
    long = C("direction") == "LONG"
    reached = (F.when(long, (C("_l") <= C("stop_loss")) | (C("_h") >= C("take_profit")))
               .otherwise((C("_h") >= C("stop_loss")) | (C("_l") <= C("take_profit"))))
    first_hour = hours.join(positions, "symbol").filter(reached).groupBy("position_id").agg(F.min("_hour").alias("_hour"))
    at = positions.join(first_hour, "position_id")
    hits = level_hits(ticks.withColumn("_hour", F.date_trunc("hour", "ts")), at, ["symbol", "_hour"])
    first = F.min_by(F.struct("symbol", "direction", "ts", "price", "exit_flag"), F.struct("ts", "event_id"))
    return hits.groupBy("position_id").agg(first.alias("_h")).select("position_id", "_h.*")


def chain_readings(payloads: DataFrame) -> DataFrame:
    """PCR of each chain snapshot (symbol, ts, payload) of a stream or table; append as history."""
    strikes = flatten_chain(payloads)
    out = strikes.groupBy("symbol", "ts").agg(F.sum("pe_oi").alias("put_oi"), F.sum("ce_oi").alias("call_oi"))
    return out.withColumn("pcr", F.round(C("put_oi") / F.greatest(F.lit(1), C("call_oi")), 3))


def append_readings(history_path: str):
    """A foreachBatch writer that adds each batch's readings to the history table.

    The batch id is a directory, so a batch repeated after a failure replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        chain_readings(batch).write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
    return write


def write_latest(path: str):
    """A foreachBatch writer of `latest` in complete mode: one table with a row per symbol, replaced as a whole.

    The stream's own state holds the latest quote of each symbol, so a restarted stream forgets
    nothing and a batch that is repeated writes the same table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return write
