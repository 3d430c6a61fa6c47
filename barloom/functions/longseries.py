"""Splitting of series too long for one task, with exact results.

Daily bars need no split: (symbol, date) is unique, so a symbol cannot hold more rows
than the calendar has days. Series keyed by timestamps have no such bound; one symbol
may hold a third of the table. `split_series` numbers the rows of every symbol without
gathering them (counts per symbol and time bucket, then a prefix sum over the buckets),
cuts each symbol into parts of equal row count and copies `halo` rows of the previous
part (and `ahead` rows of the next) into each part. Every frame and recurrence then runs
per part. What has unbounded memory (running totals, last event, forward fill) takes its
value at the start of the part from `carried`. `merge_series` drops the copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import IndicatorConfig
from barloom.functions.cols import Series
from barloom.functions.recur import FAINT

FRAMES = 512  # longest look-back of chained frames


def halo_rows(cfg: IndicatorConfig) -> int:
    """Rows to copy so that frames are whole and two chained recurrences of the longest period forget what is missing."""
    slowest = max(*(1 - 2 / (n + 1) for n in (cfg.ema_fast, cfg.ema_slow, cfg.macd_fast, cfg.macd_slow, cfg.macd_signal, 20)),
                  *(1 - 1 / n for n in (cfg.rsi_period, cfg.atr_period, cfg.adx_period, cfg.st_atr_period)))
    return max(FRAMES, cfg.sma_long + cfg.fib_rows) + (2 * math.ceil(FAINT / -math.log2(slowest)) if slowest > 0 else 0)


def numbered(df: DataFrame, bucket: str = "day", by: str = "symbol") -> DataFrame:
    """Row number `_row` (from 0) of each row in its whole series; no task sees a whole series.

    The largest group a task sorts is one (series, bucket); choose `bucket` so that it fits.
    """
    cut = df.withColumn("_bucket", F.date_trunc(bucket, F.col("ts")))
    starts = (
        cut.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
        .withColumn("_start", F.coalesce(F.sum("_cnt").over(
            Window.partitionBy(by).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_cnt")
    )
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("ts")) - 1
    return (cut.join(starts, [by, "_bucket"])
            .withColumn("_row", F.col("_start") + inside).drop("_bucket", "_start"))


def split_series(df: DataFrame, rows: int = 65536, halo: int | None = None, ahead: int = 64,
                 bucket: str = "day", cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """Cut long series into parts of `rows` rows with copied edges; `_side` 0 marks the real rows.

    The edge before a part follows from the periods of `cfg` unless `halo` gives it.
    """
    halo = halo_rows(cfg) if halo is None else halo
    if halo > rows or ahead > rows:
        raise ValueError("a part must be at least as long as its copied edges")
    r = F.col("_row")
    home = F.floor(r / rows)
    copies = F.filter(
        F.array(home,
                F.when(r % rows >= rows - halo, home + 1),
                F.when((r % rows < ahead) & (home > 0), home - 1)),
        lambda x: x.isNotNull())
    return (numbered(df, bucket)
            .withColumn("_part", F.explode(copies))
            .withColumn("_side", F.signum(home - F.col("_part")).cast("int"))
            .drop("_row"))


def merge_series(df: DataFrame) -> DataFrame:
    if "_part" not in df.columns:
        return df
    return df.filter("_side = 0").drop("_part", "_side")


def carried(df: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """State at the start of each part. `values`: name -> ('sum' | 'last', column).

    One row per part is aggregated and prefix-combined per symbol, then joined back by
    (symbol, part); nothing is added when the series were not split.
    """
    if "_part" not in df.columns:
        return df.withColumns({
            name: F.lit(0.0) if kind == "sum" else F.lit(None).cast("double")
            for name, (kind, _) in values.items()})
    prior = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    aggs, prefix = [], {}
    for name, (kind, c) in values.items():
        if kind == "sum":
            aggs.append(F.sum(c).alias(name))
            prefix[name] = F.coalesce(F.sum(name).over(prior), F.lit(0.0))
        else:
            aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col("ts"))).alias(name))
            prefix[name] = F.last(name, ignorenulls=True).over(prior)
    ends = df.filter("_side = 0").groupBy("symbol", "_part").agg(*aggs).withColumns(prefix)
    return df.join(ends, ["symbol", "_part"])


def forward_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last known value of each column in time order, per series."""
    state = carried(df, {f"_ff_{c}": ("last", F.col(c)) for c in columns}) if "_part" in df.columns else df
    s = Series(state)
    out = {}
    for c in columns:
        seen = F.last(c, ignorenulls=True).over(s.past)
        out[c] = F.coalesce(seen, F.col(f"_ff_{c}")) if "_part" in df.columns else seen
    return state.withColumns(out).drop(*[f"_ff_{c}" for c in columns])
