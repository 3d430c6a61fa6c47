"""Column helpers. Missing values are null throughout; comparisons with null count as false in flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x: float) -> Column:
    return F.lit(float(x))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def div(a, b) -> Column:
    """a / b with a zero denominator giving null."""
    return col(a) / F.nullif(col(b), num(0))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, num(lo)), num(hi)))


def fill(c: Column, default) -> Column:
    return F.coalesce(c, default if isinstance(default, Column) else num(default))


def ratio(a, b, default: float = 0.0) -> Column:
    """Relative distance a / b - 1, default when undefined, within +-0.5."""
    return clip(fill(div(a, b) - 1, default), -0.5, 0.5)


def ladder(steps, otherwise) -> Column:
    """First matching (condition, value) pair."""
    out = None
    for cond, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


# --- normal distribution -------------------------------------------------------------
# Coefficients of the published rational approximation of the normal
# distribution function (absolute error below 7.5e-8).
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    k = 1 / (1 + NORMAL_P * F.abs(x))
    poly = num(0)
    for b in reversed(NORMAL_B):
        poly = (poly + b) * k
    upper = 1 - norm_pdf(x) * poly
    return F.when(x >= 0, upper).otherwise(1 - upper)


BAR_COLUMNS = ("open", "high", "low", "close", "volume")
NEVER_NULL = {"_tr", "_pdm", "_ndm", "_dx"}  # moves that have a default by construction


class Series:
    """Frames over one series: `symbol` (and its part, when a long series was split), in time order."""

    def __init__(self, df: DataFrame, by: tuple = ("symbol",), order: str = "ts"):
        self.columns = set(df.columns)
        self.indexed = "_n" in self.columns
        self.split = "_part" in df.columns
        self.by = list(by) + (["_part"] if self.split else [])
        self.order = (["_blk"] if "_blk" in df.columns else []) + [order]
        self.w = Window.partitionBy(*self.by).orderBy(*self.order)
        self.past = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.w.rowsBetween(Window.unboundedPreceding, -1)

    def running(self, c) -> Column:
        """Running total from the first real row on; on rows copied before it, what is missing to it."""
        total = F.sum(c).over(self.past)
        if not self.split:
            return total
        whole = self.rows(Window.unboundedPreceding, Window.unboundedFollowing)
        return total - F.coalesce(F.sum(F.when(F.col("_side") < 0, col(c))).over(whole), num(0))

    def rows(self, first: int, last: int):
        return self.w.rowsBetween(first, last)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)

    def roll(self, agg, c, n: int, least: int | None = None, shift: int = 0) -> Column:
        """agg over the last n rows (shifted back by `shift`), null until `least` non-null rows are seen.

        Values of bar columns in a frame are the difference of two running counts.
        """
        frame = self.rows(-(n - 1) - shift, -shift)
        least = n if least is None else least
        if isinstance(c, str) and c in NEVER_NULL and self.indexed:
            return F.when(F.col("_n") >= least + shift, agg(c).over(frame))
        if isinstance(c, str) and f"_k_{c}" in self.columns:
            seen = (self.lag(f"_k_{c}", shift) if shift else F.col(f"_k_{c}")) - F.coalesce(self.lag(f"_k_{c}", n + shift), F.lit(0))
            return F.when(seen >= least, agg(c).over(frame))
        return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))

    def mean(self, c, n, least=None):
        return self.roll(F.avg, c, n, least)

    def total(self, c, n, least=None):
        return self.roll(F.sum, c, n, least)

    def high(self, c, n, least=None, shift=0):
        return self.roll(F.max, c, n, least, shift)

    def low(self, c, n, least=None, shift=0):
        return self.roll(F.min, c, n, least, shift)

    def std(self, c, n, least=None):
        return self.roll(F.stddev_samp, c, n, least)

    def quantile(self, c, q: float, n: int, least=None):
        """Exact interpolated quantile of the frame."""
        return self.roll(lambda x: F.percentile(x, F.lit(q)), c, n, least)

    def parts(self, agg, c: str, part: str, rows: int, n: int, least: int | None = None) -> Column:
        """Frame of n rows of a bar column from column `part`, which holds the frame of `rows` rows of each row.

        The n rows are the frames at every `rows`-th lag, so the cost is `rows` + n / `rows`, not n.
        `agg` combines the columns of the frames; missing ones are null.
        """
        if n % rows:
            raise ValueError("a frame must be made of whole parts")
        seen = F.col(f"_k_{c}") - F.coalesce(self.lag(f"_k_{c}", n), F.lit(0))
        return F.when(seen >= (n if least is None else least), agg([F.col(part), *[self.lag(part, rows * i) for i in range(1, n // rows)]]))

    def values(self, c, n: int) -> Column:
        return F.collect_list(c).over(self.rows(-(n - 1), 0))


def rank_pct(value, frame_values, least: int) -> Column:
    """Average-tie rank of `value` among the collected frame, as a share of its size."""
    v, arr = col(value), col(frame_values)
    # Twice the number of smaller values and once that of equal ones, in one walk over the frame.
    twice = F.aggregate(arr, F.lit(0), lambda n, x: n + F.when(x < v, 2).when(x == v, 1).otherwise(0))
    return F.when(v.isNotNull() & (F.size(arr) >= least), (twice + 1) / 2 / F.size(arr))


def above_median(value, frame_values, least: int) -> Column:
    """Whether `value`, one of the collected frame, lies above the frame's median.

    No value lies between the two in the middle, so it does if at least half of the frame is
    smaller: a count, without sorting the frame.
    """
    v, arr = col(value), col(frame_values)
    return (F.size(arr) >= least) & (F.size(F.filter(arr, lambda x: x < v)) * 2 >= F.size(arr))


def edge_weights(window: int, degree: int, deriv: int = 0, edge: str = "right") -> list[float]:
    """Least-squares polynomial weights, newest first, evaluated at one end of the window.

    `edge='right'` evaluates at the newest point; 'left' at the oldest.
    """
    import numpy as np

    at = 0.0 if edge == "right" else -(window - 1.0)
    x = -np.arange(window, dtype=float) - at
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    return [float(v) for v in fit[deriv] * math.factorial(deriv)]


def fir(s: Series, c, weights: list[float]) -> Column:
    """Weighted sum of the newest len(weights) values; null while history is short."""
    out = col(c) * weights[0]
    for i, w in enumerate(weights[1:], 1):
        out = out + s.lag(c, i) * w
    return out


def by_series(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition by series into the session's shuffle partitions.

    Frames cost far more per byte than the size-based coalescing of shuffle partitions
    assumes, so the exchange the frames need anyway is asked for with a fixed count.
    """
    by = by or ("symbol",)
    by = [*by, *(["_part"] if "_part" in df.columns else [])]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)
