"""Incremental clustering against a plain version and its SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from barloom.llm import incremental_clusters, queries
from tests.llm.conftest import SMALL
from tests.llm.test_tokens import bag


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assigned():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        groups = {}
        for _, c, _, v in assigned():
            groups.setdefault(c, []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    end = assigned()
    totals = {}
    for _, c, d, _ in end:
        totals[c] = totals.get(c, 0) + d
    return [(i, c, d, totals[c], sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d, _ in end]


def some_rows(n, kind):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(64)]) for i in range(n)]
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 63 + [None]), (1004, [math.nan] * 64), (1005, [math.inf] + [0.0] * 63), (None, [0.25] * 64)]
    return [(i, v if v is None or kind == "double" else [x if x is None else float(f"{x:.2f}") for x in v]) for i, v in rows + odd + rows[:3] + rows[:1]]


@pytest.mark.parametrize("n", [0, 7, 200])
def test_plain(spark, n):
    rows = some_rows(n, "double")
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, q string")
    assert bag(incremental_clusters.clustered(frame).collect()) == bag(plain(rows))


def test_empty_and_large(spark):
    assert incremental_clusters.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="too large"):
        incremental_clusters.clustered(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>"))


def test_only_moved_components_count(spark):
    """Dots follow moves exactly, whatever the order of moves."""
    import numpy as np
    rng = np.random.default_rng(1)
    a, b = rng.integers(-50, 50, (2, 4, 64))
    b[0] = a[0]
    b[1, 5:] = a[1, 5:]
    x = rng.integers(-50, 50, (30, 64))
    frame = spark.createDataFrame([(i, v.tolist(), int((v * v).sum()), (a @ v).tolist()) for i, v in enumerate(x)], "vec_id long, q array<int>, norm long, dots array<long>")
    got = sorted(incremental_clusters.moved(frame, a, b).collect())
    assert [r.dots for r in got] == (x @ b.T).tolist()
    away = ((x[:, None] - b[None]) ** 2).sum(2)
    assert [r.distance for r in got] == away.min(1).tolist() and [r.cluster for r in got] == away.argmin(1).tolist()


def test_registered_and_sql(spark):
    got = queries.QUERIES["op13_centroid_clusters"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    twin = con.execute(queries.SQL["op13_centroid_clusters"]).df()
    assert sorted(twin.columns) == sorted(got.columns)
    assert bag(got.collect()) == bag(twin[got.columns].itertuples(index=False, name=None))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert bag(got.collect()) == bag(plain(rows))
