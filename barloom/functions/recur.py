"""First-order recurrences y[t] = q*y[t-1] + u[t] as plain window sums, exact for every decay.

Within a block of rows the recurrence is a running sum of u[i] * q**-p(i) scaled by q**p(t);
the value at the end of the previous block is carried in with one running `last`. The length
of a block follows from the decay: long enough that what lies two blocks back is weighed
below double precision, short enough that q**-p stays in range. Decays of short periods
share blocks of BLOCK rows, so a panel needs one ordering for all of them; a longer period
gets longer blocks. q = 0 is the input itself. All work stays in JVM window functions and
is linear in the rows.

Inputs of a step are not null from its first row on. `exponential_mean` takes inputs with
nulls: they repeat the last value and age it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import BAR_COLUMNS, Series, by_series, col, num

BLOCK = 512
FAINT, RANGE = 54, 900  # powers of two: weight of what is left out, and how far q**-p may grow


@dataclass(frozen=True)
class Step:
    """`feed` is the input u, `q` the decay, `first` the first row (from 1) with a result."""

    feed: Column
    q: float
    first: int


def block_rows(q: float) -> int:
    """Rows of a block: BLOCK where q**BLOCK is faint and in range, else what makes it so."""
    fall = -math.log2(q) if q > 0 else math.inf
    if fall <= 0:
        raise ValueError("a recurrence must decay")
    if FAINT <= BLOCK * fall <= RANGE:
        return BLOCK
    return max(1, int(RANGE / 2 / fall))


def indexed(df: DataFrame) -> DataFrame:
    """Add row number `_n`, block `_blk`, place in the block `_p` and running counts `_k_<bar column>`."""
    if "_blk" in df.columns:
        return df
    s = Series(df)
    df = df.withColumns({"_n": F.row_number().over(s.w), **{f"_k_{c}": F.count(c).over(s.past) for c in BAR_COLUMNS if c in df.columns}})
    return df.withColumns({
        "_blk": F.floor((F.col("_n") - 1) / BLOCK),
        "_p": (F.col("_n") - 1) % BLOCK,
    })


def unindexed(df: DataFrame) -> DataFrame:
    return df.drop("_n", "_blk", "_p")


def ema(c, alpha: float, start: int = 1, least: int = 1) -> Step:
    """Exponential mean seeded with the first value; `start` is the row where input begins."""
    feed = (F.when(F.col("_n") == start, col(c)).when(F.col("_n") > start, col(c) * alpha)
            .otherwise(num(0)))
    return Step(F.coalesce(feed, num(0)), 1 - alpha, start + least - 1)


def span_ema(c, span: int, start: int = 1, least: int | None = None) -> Step:
    return ema(c, 2 / (span + 1), start, span if least is None else least)


def wilder(c, seed, n: int, start: int = 1) -> Step:
    """((n-1)*y + x)/n seeded with the mean of the first n inputs, given as column `seed`."""
    at = start + n - 1
    feed = F.when(F.col("_n") == at, col(seed)).when(F.col("_n") > at, col(c) / n).otherwise(num(0))
    return Step(F.coalesce(feed, num(0)), (n - 1) / n, at)


def scan(df: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """Add one column per recurrence. Needs `indexed`."""
    s = Series(df)
    n = F.col("_n")
    groups: dict[int, dict[str, Step]] = {}
    for name, st in steps.items():
        if st.q > 0:
            groups.setdefault(block_rows(st.q), {})[name] = st
    local, carry, out, extra = {}, {}, {}, {}
    for size, some in groups.items():
        if size == BLOCK:
            key, p = "_blk", F.col("_p")
        else:
            key, p = f"_blk{size}", (n - 1) % size
            extra[key] = F.floor((n - 1) / size)
        block = Window.partitionBy(*s.by, key).orderBy(*[o for o in s.order if o != key])
        block = block.rowsBetween(Window.unboundedPreceding, 0)
        for name, st in some.items():
            q = num(st.q)
            local[f"_l_{name}"] = F.sum(st.feed * F.pow(q, -p)).over(block) * F.pow(q, p)
            carry[f"_c_{name}"] = F.last(
                F.when(p == size - 1, F.col(f"_l_{name}")), ignorenulls=True).over(s.before)
            out[name] = F.when(
                n >= st.first,
                F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), num(0)) * F.pow(q, p + 1))
    for name, st in steps.items():
        if st.q <= 0:
            out[name] = F.when(n >= st.first, st.feed)
    if extra:
        df = df.withColumns(extra)
    if local:
        df = df.withColumns(local).withColumns(carry)
    return df.withColumns(out).drop(*local, *carry, *extra)


@dataclass(frozen=True)
class Tracker:
    """A level/velocity filter as an affine recurrence x[t] = A[t]*x[t-1] + b[t]*u[t], x[1] = 0.

    The gains do not depend on data and settle, so A[t] becomes one matrix A with eigenvalues
    r*exp(+-i*a): A**p = r**p * (cos(p*a) + sin(p*a)*B) with B*B = -1. A block of rows is then two running
    sums of the input, scaled by r**-p and turned by the angle, and the state at the end of the
    previous block is carried in. Rows before the gains settle have their coefficients in tables.
    """

    feed: str
    gains: tuple[tuple[float, float], ...]  # (level, velocity) per row, the last one settled

    def settled(self) -> tuple[float, float, np.ndarray, np.ndarray]:
        """r, angle, b and B*b of the settled filter."""
        k0, k1 = self.gains[-1]
        a = np.array([[1 - k0, 1 - k0], [-k1, 1 - k1]])
        r = math.sqrt(np.linalg.det(a))
        turn = np.trace(a) / 2 / r
        if abs(turn) >= 1:
            raise ValueError("the settled filter must swing")
        angle = math.acos(turn)
        b = np.array([k0, k1])
        return r, angle, b, (a / r - turn * np.eye(2)) @ b / math.sin(angle)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per early row: what its input adds to the two sums, and the matrix from the sums to its state."""
        r, angle, b, turned = self.settled()
        basis = np.stack([b, turned], 1)
        n = len(self.gains)
        steps = [np.array([[1 - k0, 1 - k0], [-k1, 1 - k1]]) for k0, k1 in self.gains]

        def power(p: int) -> np.ndarray:  # A**p in coordinates of the basis, from sums (s1, s2)
            c, s = math.cos(p * angle), math.sin(p * angle)
            return r**p * np.array([[c, s], [s, -c]])

        add, state, after = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.eye(2)
        last = basis @ power(n - 1)  # sums -> state at the last early row
        for i in range(n - 1, -1, -1):  # `after`: from the state at row i to that at the last early row
            add[i] = np.linalg.solve(last, after @ np.array(self.gains[i]))
            state[i] = np.linalg.solve(after, last) if i else 0
            if i:
                after = after @ steps[i]
        return add, state


def track(df: DataFrame, name: str, t: Tracker) -> DataFrame:
    """Add `<name>_level` and `<name>_velocity`. Needs `indexed`; the filter starts at rest on the first value."""
    s = Series(df)
    n, p = F.col("_n"), F.col("_p")
    r, angle, b, turned = t.settled()
    add, state = t.tables()
    early, first = len(t.gains), F.first(t.feed).over(s.past)

    def entry(values) -> Column:
        return F.get(F.array(*[num(v) for v in values]), n - 1)

    df = df.withColumn("_ku", F.col(t.feed) - first)
    u, grown, turn = F.col("_ku"), F.pow(num(r), p), p * angle
    block = Window.partitionBy(*s.by, "_blk").orderBy(*[o for o in s.order if o != "_blk"]).rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(n <= early, entry(add[:, 0])).otherwise(F.cos(turn) / grown)
    two = F.when(n <= early, entry(add[:, 1])).otherwise(F.sin(turn) / grown)
    df = df.withColumns({"_k1": F.sum(u * one).over(block), "_k2": F.sum(u * two).over(block)})
    cos, sin = F.cos(turn) * grown, F.sin(turn) * grown
    inner, outer = cos * F.col("_k1") + sin * F.col("_k2"), sin * F.col("_k1") - cos * F.col("_k2")

    def local(k: int) -> Column:
        return F.when(n <= early, entry(state[:, k, 0]) * F.col("_k1") + entry(state[:, k, 1]) * F.col("_k2")).otherwise(inner * b[k] + outer * turned[k])

    df = df.withColumns({"_kx": local(0), "_kv": local(1), "_kz": first})
    ends = {f"_ke{c}": F.last(F.when(p == BLOCK - 1, F.col(c)), ignorenulls=True).over(s.before) for c in ("_kx", "_kv")}
    df = df.withColumns(ends)
    # A**(p+1) times the carried state, by its coordinates in the basis (b, B*b).
    inverse = np.linalg.inv(np.stack([b, turned], 1))
    x, v = F.coalesce("_ke_kx", num(0)), F.coalesce("_ke_kv", num(0))
    e, f = x * inverse[0, 0] + v * inverse[0, 1], x * inverse[1, 0] + v * inverse[1, 1]
    more, cos1, sin1 = F.pow(num(r), p + 1), F.cos((p + 1) * angle), F.sin((p + 1) * angle)
    along, across = (e * cos1 - f * sin1) * more, (e * sin1 + f * cos1) * more
    return df.withColumns({f"{name}_level": F.col("_kz") + F.col("_kx") + along * b[0] + across * turned[0],
                           f"{name}_velocity": F.col("_kv") + along * b[1] + across * turned[1]}).drop("_ku", "_k1", "_k2", "_kx", "_kv", "_kz", *ends)


def exponential_mean(df: DataFrame, c: str, name: str, span: float, by: tuple = ("symbol",), order: str = "ts") -> DataFrame:
    """Exponential mean of a column that may hold nulls, per series in time order.

    A null repeats the mean before it. The value after a gap weighs against a mean aged by
    the gap: y = (d*y + a*x) / (d + a) with d = (1-a)**(nulls between + 1). Before the first
    value the mean is null. Only values form blocks, so a long gap cannot push the mean out
    of what is carried.
    """
    a = 2 / (span + 1)
    q = 1 - a
    if q <= 0:
        out = by_series(df, *by)
        return out.withColumn(name, F.last(c, ignorenulls=True).over(Series(out, by, order).past))
    made = by_series(df, *by)
    s = Series(made, by, order)
    made = made.withColumns({"_n": F.row_number().over(s.w), "_k": F.count(c).over(s.past)})
    made = made.withColumn("_gap", F.col("_n") - F.last(F.when(F.col(c).isNotNull(), F.col("_n")), ignorenulls=True).over(s.before))
    aged = F.pow(num(q), F.col("_gap"))
    first = F.col("_gap").isNull()
    made = made.withColumns({
        "_u": F.when(F.col(c).isNull(), num(0)).when(first, F.col(c)).otherwise(F.col(c) * a / (aged + a)),
        "_w": F.when(F.col(c).isNull() | first, num(0)).otherwise(F.ln(F.greatest(aged / (aged + a), num(1e-300))))})
    # Blocks by the weight lost so far, which keeps exp(-sum) in range; within one it falls by 2**-(RANGE/2).
    made = made.withColumn("_age", F.sum("_w").over(s.past))
    made = made.withColumn("_b", F.floor(F.col("_age") / (-RANGE / 2 * math.log(2))))
    block = Window.partitionBy(*s.by, "_b").orderBy(*s.order)
    inside = block.rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("_base", F.first("_age").over(inside))
    scale = F.col("_age") - F.col("_base")
    made = made.withColumn("_local", F.sum(F.col("_u") * F.exp(-scale)).over(inside) * F.exp(scale))
    ends = F.lead("_b").over(s.w) != F.col("_b")
    made = made.withColumn("_end", F.when(ends, F.struct("_local", "_age")))
    carried = F.last("_end", ignorenulls=True).over(s.before)
    made = made.withColumn("_from", carried)
    value = F.col("_local") + F.coalesce(F.col("_from._local") * F.exp(F.col("_age") - F.col("_from._age")), num(0))
    return made.withColumn(name, F.when(F.col("_k") > 0, value)).select(*df.columns, name)
