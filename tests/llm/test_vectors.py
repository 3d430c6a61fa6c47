"""Vector search against brute force."""

import numpy as np
import pytest

from barloom.llm import adaptive_scan


def plain(vectors, queries, k):
    out = {}
    for q, x in queries.items():
        scores = sorted(((-float(x @ y), i) for i, y in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def results(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def vectors_of(df):
    return {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}


@pytest.mark.parametrize("blocks", [4096, 100])
def test_recall(spark, monkeypatch, blocks):
    monkeypatch.setattr(adaptive_scan, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(adaptive_scan, "PER_LIST", 100)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = vectors_of(df)
    exact = plain(x, {i: v for i, v in x.items() if i % 20 == 0}, 20)
    got = results(adaptive_scan.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got.keys() == exact.keys() and all(len(v) == 20 for v in got.values())
    assert all(abs(s - float(x[q] @ x[i])) < 1e-12 for q, found in got.items() for i, s in found)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) / 20 for q in exact]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, -1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, list string, rank string")
    got = results(adaptive_scan.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == {0: [(20, 2.0), (1, 0.5), (2, 0.5)], 20: [(0, 2.0), (1, 0.5), (2, 0.5)]}
    assert adaptive_scan.nearest(df.filter("false"), df).count() == 0
    assert adaptive_scan.nearest(df, df.filter("false")).count() == 0


def test_copies(spark):
    """A third of all rows are one vector."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = results(adaptive_scan.nearest(df, df.filter("vec_id = 0")).collect())
    assert [i for i, _ in got[0]] == [3 * i for i in range(1, 21)]
