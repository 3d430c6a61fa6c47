"""Bars from lines with repeated and missing keys, against a plain fold."""

import datetime
import random
from collections import defaultdict

from barloom.sources import tables

START = datetime.datetime(1995, 3, 1)


def test_bars_look_up_their_ends(spark, tmp_path):
    rng = random.Random(5)
    parts = [(k, None if k == 7 else f"B{k % 3}", k % 5) for k in range(12)]
    lines = [(rng.choice((None, *range(9))), rng.choice((None, 1, 2)), rng.randrange(14), rng.choice((None, 3, 4)), float(rng.randrange(1, 60)), float(rng.randrange(1, 4)),
              rng.choice((None, *[START + datetime.timedelta(hours=13 * i) for i in range(8)]))) for _ in range(600)]
    lines += [(None, 1, 1, 1, 10.0 + i, 1.0, START + datetime.timedelta(days=40)) for i in range(3)]  # a bar without any order key
    lines += lines[:50]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    groups = defaultdict(list)
    for line in lines:
        if line[2] < len(parts):
            groups[parts[line[2]][1], line[6] and line[6].date()].append(line)
    want = []
    for (symbol, day), some in groups.items():
        some.sort(key=lambda r: [(x is not None, x or 0) for x in (*r[:4], r[4], r[5])])  # null comes first
        prices = [r[4] / r[5] for r in some]
        want.append((symbol, day, prices[0], max(prices), min(prices), prices[-1], sum(r[5] for r in some)))
    got = tables.bars(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan  # only lines of end orders are sorted
    assert "lineitem" not in got.select("ts").distinct()._jdf.queryExecution().executedPlan().toString()  # dates do not read lines again
