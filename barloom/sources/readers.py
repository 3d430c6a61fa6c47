"""Readers, normalisers, filters and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col

BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "close_raw")]])


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars between two dates (both included, either may be left out); folders of other years are not opened."""
    df = spark.read.schema(T.StructType([*BARS.fields, T.StructField("year", T.IntegerType())])).parquet(path)
    if start is not None:
        df = df.filter((C("year") >= F.year(F.lit(start).cast("date"))) & (C("ts") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.filter((C("year") <= F.year(F.lit(end).cast("date"))) & (C("ts") <= F.lit(end).cast("date")))
    return df.drop("year")


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per year; within it rows are clustered by symbol so that scans skip by statistics."""
    (bars.withColumn("year", F.year("ts")).repartition("year", "symbol").sortWithinPartitions("symbol", "ts")
     .write.mode(mode).partitionBy("year").parquet(path))


def normalise_bars(raw: DataFrame, zone: str | None = None) -> DataFrame:
    """Keep the bar columns, drop the zone of the time, drop rows without a close."""
    ts = C("ts") if zone is None else F.from_utc_timestamp(C("ts"), zone)
    keep = [c for c in ("open", "high", "low", "close", "volume") if c in raw.columns]
    return raw.select("symbol", ts.cast("timestamp_ntz").alias("ts"),
                      *[C(c).cast("double") for c in keep]).na.drop(subset=["close"])


def dual_track(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Adjusted bars with the raw close of the date, carried forward, else the adjusted close."""
    out = adjusted.join(raw.select("symbol", "ts", C("close").alias("_raw")), ["symbol", "ts"], "left")
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("close_raw", F.coalesce(F.last("_raw", True).over(past), C("close"))).drop("_raw")


def min_history(df: DataFrame, n: int) -> DataFrame:
    """Symbols with at least n rows; counts are aggregated, not windowed."""
    enough = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(C("_n") >= n).select("symbol")
    return df.join(enough, "symbol", "left_semi")


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(C("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


TASK_HOURS = ("09:15", "15:35")  # fixed values: when scheduled tasks run


def session_state(df: DataFrame, ts: str = "ts") -> DataFrame:
    """pre_open, open or closed by weekday and local time; `off_hours` where scheduled tasks rest."""
    day, clock = F.weekday(ts) < 5, F.date_format(ts, "HH:mm:ss")
    state = (F.when(day & (clock >= "09:15:00") & (clock <= "15:30:00"), "open")
             .when((clock >= "09:00:00") & (clock < "09:15:00"), "pre_open").otherwise("closed"))
    minute = F.date_format(ts, "HH:mm")
    return df.withColumns({"session": state, "off_hours": ~(day & (minute >= TASK_HOURS[0]) & (minute <= TASK_HOURS[1]))})


# --- option contracts -------------------------------------------------------------------

# Column headings of the exchange's contract files.
CONTRACT_COLUMNS = {
    "strike": ("STRIKE_PR", "double"), "open_int": ("OPEN_INT", "double"), "oi_change": ("CHG_IN_OI", "double"),
    "close_price": ("CLOSE", "double"), "settle_price": ("SETTLE_PR", "double"), "volume": ("CONTRACTS", "double")}
KEY = ["trade_date", "symbol", "expiry_date", "strike", "option_type"]


def number(text: Column) -> Column:
    """Number from text with thousands commas; null when malformed."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def clean_contracts(raw: DataFrame, symbols: tuple, line: str = "line") -> DataFrame:
    """Index options of the wanted symbols from an all-text table with `trade_date` and a line number.

    Headers are trimmed and upper-cased, malformed rows dropped, and of equal keys the last line wins
    (an aggregate that combines before the exchange).
    """
    df = raw.select(*[C(f"`{c}`").alias(c if c in ("trade_date", line) else c.strip().upper()) for c in raw.columns])
    df = df.filter((F.trim("INSTRUMENT") == "OPTIDX") & F.trim("SYMBOL").isin(*symbols))
    empty_is_zero = {"oi_change", "close_price", "settle_price", "volume"}
    nums = {}
    for name, (col, _) in CONTRACT_COLUMNS.items():
        text = C(col)
        nums[name] = number(F.when(text.isNull() | (F.trim(text) == ""), F.lit("0")).otherwise(text)
                            if name in empty_is_zero else text)
    df = df.select(C("trade_date").cast("date").alias("trade_date"), F.trim("SYMBOL").alias("symbol"),
                   F.try_to_date(F.trim("EXPIRY_DT"), "d-MMM-yyyy").alias("expiry_date") if hasattr(F, "try_to_date")
                   else F.to_date(F.try_to_timestamp(F.trim("EXPIRY_DT"), F.lit("d-MMM-yyyy"))).alias("expiry_date"),
                   F.trim("OPTION_TYP").alias("option_type"), *[v.alias(k) for k, v in nums.items()], C(line).alias("_l"))
    df = df.na.drop(subset=["expiry_date", *CONTRACT_COLUMNS])
    value = ["open_int", "oi_change", "close_price", "settle_price", "volume"]
    last = df.groupBy(*KEY).agg(F.max_by(F.struct(*value), "_l").alias("_v"))
    longs = {"open_int", "oi_change", "volume"}
    return last.select(*KEY, *[C(f"_v.{v}").cast("bigint" if v in longs else "double").alias(v) for v in value])


def read_contracts(spark: SparkSession, path: str, symbols: tuple) -> DataFrame:
    """CSV files whose name ends in the trade date (…yyyyMMdd.csv)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    stamped = raw.withColumns({
        "trade_date": F.to_date(F.regexp_extract(F.input_file_name(), "(\\d{8})\\.csv", 1), "yyyyMMdd"),
        "line": F.monotonically_increasing_id()})
    return clean_contracts(stamped, symbols)


def missing_days(stored: DataFrame, start: str, end: str, date: str = "trade_date") -> DataFrame:
    """Weekdays in the range after the last stored date that are not stored; the range is a calendar."""
    bounds = stored.agg(F.coalesce(F.date_add(F.max(date), 1), F.lit(start).cast("date")).alias("_from"))
    days = bounds.select(F.explode(F.when(C("_from") <= F.lit(end).cast("date"), F.sequence(
        "_from", F.lit(end).cast("date"), F.expr("interval 1 day")))).alias(date))
    return days.filter(F.weekday(date) < 5).join(stored.select(date).distinct(), date, "left_anti")


def append_days(new: DataFrame, path: str, date: str = "trade_date") -> None:
    """Write or replace only the dates in `new`; rows of one date come from as many tasks as their size asks for."""
    (new.hint("rebalance", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date).parquet(path))


# Field names of an option chain's JSON.
SIDE = "struct<lastPrice:double,openInterest:bigint,changeinOpenInterest:bigint,totalTradedVolume:bigint>"
CHAIN = ("struct<records:struct<underlyingValue:double,expiryDates:array<string>,"
         f"data:array<struct<expiryDate:string,strikePrice:double,CE:{SIDE},PE:{SIDE}>>>>")


def flatten_chain(df: DataFrame, payload: str = "payload", expiry: str | None = None) -> DataFrame:
    """One row per strike of the chosen (else first) expiry; strike 0 dropped, missing sides are 0."""
    keep = [c for c in df.columns if c != payload]
    rec = df.withColumn("_r", F.from_json(payload, CHAIN)["records"])
    want = F.lit(expiry) if expiry else F.get(C("_r.expiryDates"), F.lit(0))
    rows = rec.select(*keep, C("_r.underlyingValue").alias("spot"), want.alias("_want"), F.explode("_r.data").alias("_d"))
    rows = rows.filter((C("_d.expiryDate") == C("_want")) & (C("_d.strikePrice") != 0))
    fields = {"ltp": ("lastPrice", 0.0), "oi": ("openInterest", 0), "oi_change": ("changeinOpenInterest", 0),
              "volume": ("totalTradedVolume", 0)}
    sides = [F.coalesce(C(f"_d.{s}.{f}"), F.lit(z)).alias(f"{s.lower()}_{n}")
             for s in ("CE", "PE") for n, (f, z) in fields.items()]
    return rows.select(*keep, "spot", F.to_date("_want", "d-MMM-yyyy").alias("expiry_date"),
                       C("_d.strikePrice").alias("strike"), *sides)


# --- reports ----------------------------------------------------------------------------


def write_report(folder: str, equity: DataFrame, monthly: DataFrame, log: DataFrame, summary: DataFrame) -> None:
    """The four tables of a report."""
    for name, df in {"equity_curve": equity, "monthly_returns": monthly, "trade_log": log, "summary": summary}.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
