"""Vector search on tables that repeat ids."""

import numpy as np

from barloom.llm import adaptive_scan
from tests.llm.test_vectors import plain, results, vectors_of

SCHEMA = "vec_id long, embedding array<float>"


def test_table_united_with_itself(spark):
    x = np.random.default_rng(2).standard_normal((300, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)
    asked = df.filter("vec_id % 20 = 0")
    got = results(adaptive_scan.nearest(df.union(df), asked).collect())
    exact = plain(vectors_of(df), vectors_of(asked), 20)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in exact.items()}


def test_many_vectors_under_one_id(spark):
    x = np.random.default_rng(3).standard_normal((100, 8))
    rows = [(i, row) for i, row in enumerate(x)] + [(7, x[0] * (2 + j / 50)) for j in range(50)]  # all near query 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in rows], SCHEMA)
    got = [r.vec_id for r in adaptive_scan.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    scores = {}
    for r in df.collect():
        if r.vec_id:
            scores.setdefault(r.vec_id, []).append(float(np.dot(np.array(r.embedding), x[0])))
    assert got == sorted(scores, key=lambda i: -max(scores[i]))[:20] and got[0] == 7


def test_double_vectors_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)) * (1 + 1e-9 * rng.normal(size=(60, 8)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in adaptive_scan.nearest(frame, frame.filter("vec_id < 5"), k=4).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) <= 1e-12
