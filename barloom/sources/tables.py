"""Market views over the supplied star-schema tables: bars, contracts, vix, ticks, articles, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Lines with brand and size of their part; only those whose order key is among `orders`, if given."""
    li = table(spark, sf_dir, "lineitem")
    if orders is not None:
        li = li.join(orders, li.l_orderkey.eqNullSafe(orders[orders.columns[0]]), "left_semi")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per brand and ship date.

    Open and close come from the first and last line in the order of `key`, which only a sort of all
    lines could aggregate. So a first pass sums plain numbers, with the first and last order key of
    each bar (null comes first), and is written: at most two keys a bar. Open and close
    then look only at lines of those orders.
    """
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    by = [F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("ts")]
    sums = cut(_sales(spark, sf_dir).groupBy(*by).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").cast("double").alias("volume"),
        F.min("l_orderkey").alias("_from"), F.max("l_orderkey").alias("_to"), F.count_if(F.col("l_orderkey").isNull()).alias("_unknown")))
    first = F.when(F.col("_unknown") == 0, F.col("_from"))
    orders = sums.select(F.explode(F.array(first, "_to")).alias("_order")).distinct()
    ends = _sales(spark, sf_dir, orders).groupBy(*by).agg(F.min_by(price, key).alias("open"), F.max_by(price, key).alias("close"))
    ends = ends.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), "open", "close")
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("ts").eqNullSafe(F.col("_ts"))
    return sums.join(ends, same, "left").select("symbol", "ts", "open", "high", "low", "close", "volume")


# Brands that stand for index symbols where a query is about an index.
INDEX_SYMBOLS = ("Brand#1", "Brand#2", "Brand#3")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly option contracts of all brands: sales of the first half expire on the 15th, the others at the month's end."""
    day = F.to_date("l_shipdate")
    return (
        _sales(spark, sf_dir)
        .groupBy(F.col("p_brand").alias("symbol"),
                 F.trunc(day, "month").alias("trade_date"), F.when(F.dayofmonth(day) <= 14, F.date_add(F.trunc(day, "month"), 14)).otherwise(F.last_day(day)).alias("expiry_date"),
                 (F.col("p_size") * 200).cast("double").alias("strike"),
                 F.when(F.col("l_linestatus") == "F", "CE").otherwise("PE").alias("option_type"))
        .agg(F.sum("l_quantity").cast("bigint").alias("open_int"),
             (F.floor(F.avg(F.col("l_extendedprice") * F.col("l_discount") / F.col("l_quantity")) * 100 + 0.5001) / 100)
             .alias("settle_price"),
             F.count(F.lit(1)).alias("volume"))
    )


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily market volatility level from the mean discount."""
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts"))
        .agg(F.round(F.greatest(F.lit(8.0), 15 + (F.avg("l_discount") - 0.05) * 600), 4).alias("vix"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a publication time; whole texts."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.col("source").alias("title"), F.col("text").alias("summary"),
        F.expr("TIMESTAMP'2024-01-31 00:00:00' - make_dt_interval(0, CAST(doc_id AS INT))").alias("published"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily news level from 0 to 100: a document a day, the first the newest."""
    day = F.date_sub(F.lit("2001-11-04").cast("date"), F.col("doc_id").cast("int"))
    return table(spark, sf_dir, "documents").groupBy(day.alias("ts")).agg(F.avg(F.pmod("n_chars", F.lit(101)).cast("double")).alias("sentiment"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as closed trades of one account."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("fill_id"), F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("trade_value"), (50 + k % 50).cast("double").alias("ml_confidence"),
        (50 + k * 7 % 50).cast("double").alias("tech_score"),
        (F.col("o_totalprice") * (k % 11 - 5).cast("double") / 128).alias("pnl"))
