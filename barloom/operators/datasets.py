"""Walk-forward folds, splits, class weights and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import Series

C = F.col


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with their position; as many rows as the calendar has days."""
    days = bars.select("ts").distinct()
    spot = Window.orderBy("ts")
    return days.withColumns({
        "i": F.row_number().over(spot) - 1,
        "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})


def fold_dates(bars: DataFrame, k: int = 4, purge: int = 10, embargo: int = 0) -> DataFrame:
    """(fold, side, ts): which dates train or test in each fold, by position in the calendar.

    Windows are n/(k+2) dates; training ends at date w*(f+1), the test window starts `purge`
    dates later. A positive `embargo` removes that many dates after the test windows of
    earlier folds from training.
    """
    w, f, i = F.floor(C("n") / (k + 2)), C("fold"), C("i")
    end, start = w * (f + 1), w * (f + 1) + purge
    stop = start + w
    train = i <= end
    if embargo:
        was_stop = w * f + purge + w
        train = train & ~((f > 0) & (i > was_stop) & (i <= was_stop + embargo))
    side = F.when(train, "train").when((i >= start) & (i <= F.least(stop, C("n") - 1)), "test")
    return (calendar(bars).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .filter(stop <= C("n")).withColumn("side", side).filter("side is not null")
            .select("fold", "side", "ts"))


def folds(bars: DataFrame, k: int = 4, purge: int = 10, embargo: int = 0) -> DataFrame:
    """One row per fold with its boundary dates."""
    train, test = C("side") == "train", C("side") == "test"
    return fold_dates(bars, k, purge, embargo).groupBy("fold").agg(
        F.max(F.when(train, C("ts"))).alias("train_cutoff"),
        F.min(F.when(test, C("ts"))).alias("test_start"),
        F.max(F.when(test, C("ts"))).alias("test_end"))


def assign(bars: DataFrame, k: int = 4, purge: int = 10, embargo: int = 0, least: int = 20) -> DataFrame:
    """Rows with (fold, side); a symbol with `least` rows or fewer on a side is left out of it.

    The fold table is keyed by date, so this is an equi join; the row counts are aggregated
    before they meet the rows again.
    """
    rows = bars.join(fold_dates(bars, k, purge, embargo), "ts")
    enough = (rows.groupBy("symbol", "fold", "side").agg(F.count(F.lit(1)).alias("_n"))
              .filter(C("_n") > least).drop("_n"))
    return rows.join(enough, ["symbol", "fold", "side"], "left_semi")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def chronological_split(bars: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Add `part` train/valid/test by cumulative row share of each date; dates are never divided."""
    per_day = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("_c").over(run) / F.sum("_c").over(Window.partitionBy(F.lit(1)))
    days = per_day.withColumn("_s", share).select("ts", F.when(C("_s") <= train, "train").when(
        C("_s") <= valid, "valid").otherwise("test").alias("part"))
    return bars.join(days, "ts")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives over positives (at least one), one row."""
    pos, neg = F.count_if(C(label) == 1), F.count_if(C(label) == 0)
    return df.agg(pos.alias("positives"), neg.alias("negatives"),
                  (neg / F.greatest(F.lit(1), pos)).alias("weight"))


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced `weight` column: n / (2 * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    return (df.join(F.broadcast(sizes.join(F.broadcast(total))), label)  # one row per class
            .withColumn("weight", C("_t") / (2 * C("_c"))).drop("_c", "_t"))


def sequences(df: DataFrame, columns: list[str], length: int = 30, stride: int = 1,
              label: str = "label") -> DataFrame:
    """Sliding windows of `length` rows of each symbol with the label of the last row.

    With `stride` every stride-th window of a series is kept, counted from the first full one.
    """
    s = Series(df)
    out = df.withColumns({
        "_i": F.row_number().over(s.w),
        "sequence": F.collect_list(F.array(*columns)).over(s.rows(-(length - 1), 0))})
    out = out.filter((C("_i") > length) & ((C("_i") - length - 1) % stride == 0))
    return out.select("symbol", "ts", "sequence", label)


def sequence_stride(df: DataFrame, samples: int, length: int = 30) -> DataFrame:
    """Per symbol, the step that gives it a share of `samples` in proportion to its history."""
    per = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "available", F.greatest(F.lit(0), C("_n") - length)).filter(C("_n") >= length + 5)
    total = per.agg(F.greatest(F.lit(1), F.sum("available")).alias("_t"))
    take = F.greatest(F.lit(5), F.floor(C("available") * samples / C("_t")))
    return (per.join(F.broadcast(total)).withColumn("take", take)  # one row of totals
            .withColumn("step", F.greatest(F.lit(1), F.floor(C("available") / C("take"))))
            .select("symbol", "available", "take", "step"))


def sampled_sequences(df: DataFrame, columns: list[str], samples: int, length: int = 30,
                      label: str = "label") -> DataFrame:
    """Sequences taken at the proportional step of each symbol, up to its share."""
    steps = sequence_stride(df, samples, length)
    s = Series(df)
    out = df.withColumns({
        "_i": F.row_number().over(s.w) - 1 - length,
        "sequence": F.collect_list(F.array(*columns)).over(s.rows(-(length - 1), 0))})
    out = out.join(steps, "symbol").filter(
        (C("_i") >= 0) & (C("_i") % C("step") == 0) & (C("_i") / C("step") < C("take")))
    return out.select("symbol", "ts", "sequence", label)


def sequence_split(df: DataFrame, cutoff: DataFrame, least_train: int = 30, least_test: int = 10) -> DataFrame:
    """`part` train/test by a one-row cutoff date; symbols short on either side are left out."""
    out = df.join(F.broadcast(cutoff.select(C("cutoff").alias("_cut"))))  # one row
    out = out.withColumn("part", F.when(C("ts") < C("_cut"), "train").otherwise("test")).drop("_cut")
    enough = out.groupBy("symbol").agg(
        F.count_if(C("part") == "train").alias("_a"), F.count_if(C("part") == "test").alias("_b")
    ).filter((C("_a") >= least_train) & (C("_b") >= least_test))
    return out.join(enough, "symbol", "left_semi")


def cutoff_date(bars: DataFrame, share: float = 0.85) -> DataFrame:
    """First date whose rows pass `share` of the table, one row."""
    return chronological_split(bars, share, share).filter("part = 'test'").agg(F.min("ts").alias("cutoff"))
