"""Joins along time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def market_table(*series: DataFrame, on: str = "ts") -> DataFrame:
    """Daily series (ts, value...) side by side, one row per date that occurs in any of them."""
    out = series[0]
    for other in series[1:]:
        out = out.join(other, on, "full")
    return out


def asof_calendar(left: DataFrame, right: DataFrame, defaults: dict, on: str = "ts", bucket: str = "month") -> DataFrame:
    """Latest known values of market-wide series at or before each left row's time.

    The fill runs over distinct times, for all columns at once; rows then take their values by
    one equi join, broadcast by Spark when its size check allows. Dates are bounded by the
    calendar and are filled in one pass; timestamps are filled inside buckets, and what a bucket
    starts with comes from a prefix over one row per bucket.
    """
    names = [c for c in right.columns if c != on]
    calendar = left.select(on).distinct().join(right, on, "full")
    whole = Window.orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    if isinstance(left.schema[on].dataType, T.DateType):
        calendar = calendar.select(on, *[F.last(c, ignorenulls=True).over(whole).alias(c) for c in names])
    else:
        calendar = calendar.withColumn("_b", F.date_trunc(bucket, F.col(on)))
        prior = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = calendar.groupBy("_b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(f"_e_{c}") for c in names])
        starts = ends.select("_b", *[F.last(f"_e_{c}", ignorenulls=True).over(prior).alias(f"_s_{c}") for c in names])
        inside = Window.partitionBy("_b").orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
        filled = calendar.select("_b", on, *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in names])
        calendar = filled.join(starts, "_b").select(on, *[F.coalesce(c, f"_s_{c}").alias(c) for c in names])
    out = left.drop(*names).join(calendar, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items() if c in names and d is not None})


def asof_join(left: DataFrame, right: DataFrame, by: list[str], value: str, on: str = "ts",
              bucket: str = "month", default=None) -> DataFrame:
    """Latest `value` of the right side with the same keys at or before each left row.

    Both sides meet in groups of (keys, time bucket), so a hot key is spread over its
    buckets; the value at the start of a bucket comes from a prefix over bucket ends.
    """
    cut = F.date_trunc(bucket, F.col(on))
    lcols = left.columns
    lhs = left.withColumn("_b", cut)
    rhs = right.select(*by, on, value).withColumn("_b", cut)
    prior = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rhs.groupBy(*by, "_b").agg(F.max_by(value, on).alias("_end"))
    starts = (
        lhs.select(*by, "_b").distinct().join(ends, [*by, "_b"], "full")
        .withColumn("_start", F.last("_end", ignorenulls=True).over(prior))
        .select(*by, "_b", "_start")
    )
    inside = (Window.partitionBy(*by, "_b").orderBy(on, "_side")
              .rowsBetween(Window.unboundedPreceding, 0))
    both = (
        lhs.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
        .unionByName(rhs.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        .withColumn(value, F.last(value, ignorenulls=True).over(inside))
        .filter("_side = 1")
        .join(starts, [*by, "_b"])
        .withColumn(value, F.coalesce(value, "_start", *([] if default is None else [F.lit(default)])))
    )
    return both.select(*lcols, value)
