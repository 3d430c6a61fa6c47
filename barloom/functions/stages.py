"""Running many column families over one panel in few passes.

A family maps a stage number to a function `(s, cfg) -> {name: Column | Step | Tracker}`. Columns
of the same stage share one window operator whatever family they come from, and all
recurrences of a stage share one scan (a `Tracker` has its own), so a full matrix costs a handful of passes over
the sorted series instead of one per indicator. Names starting with `_` are temporary.

Stages in use: 0 frames over bars, 1 columns, 2 frames, 3 columns, 4 recurrences,
5 columns, 6 frames, 7 recurrences, 8 columns, 9 frames, 10 columns, 11 frames, 12 columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import Series, by_series
from barloom.functions.longseries import carried
from barloom.functions.recur import Step, Tracker, indexed, scan, track


class Carry(tuple):
    """(kind, column): state at the start of a part of a split series; see `carried`."""


def run(df: DataFrame, families: list[dict], cfg) -> DataFrame:
    keep = df.columns
    df = indexed(by_series(df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)))
    for stage in range(1 + max(max(f) for f in families)):
        s, columns, steps, carries, trackers = Series(df), {}, {}, {}, {}
        for family in families:
            if stage in family:
                for name, value in family[stage](s, cfg).items():
                    kind = {Step: steps, Carry: carries, Tracker: trackers}.get(type(value), columns)
                    kind[name] = value
        if columns:
            df = df.withColumns(columns)
        if carries:
            df = carried(df, carries)
        if steps:
            df = scan(df, steps)
        for name, tracker in trackers.items():
            df = track(df, name, tracker)
    return df.select([c for c in df.columns if c in keep or not c.startswith("_")])
