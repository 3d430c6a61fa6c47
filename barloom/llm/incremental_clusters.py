"""Centroid clustering on whole numbers by an incremental distance matrix.

Every vector keeps its exact integer dot product with every centroid, written to the shared
folder round by round. When centroids move, a dot product changes by the vector's product with
the move, so only components of a centroid that moved are read: columns without a change cost
nothing. Squared distance = |x|^2 - 2 dot + |c|^2, and the nearest centroid is recomputed from
the row of distances. Sums per cluster and component are exact whole numbers; what reaches the
driver is one row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut

LARGEST = 1 << 26  # of a component: 64 squared distances of twice that fit a long
STATE = "vec_id long, q array<int>, norm long, dots array<long>, cluster int, distance long"


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and q (components as floor(scale * x)) of the vectors of `dims` finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce((F.size(v) == dims) & fine, F.lit(False)))

    def part(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))

    return kept.select("vec_id", F.transform(v, part).alias("q"))


def table_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), kind))


def moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after centroids moved from `old` to `new`: dots, cluster and distance."""
    k, dims = new.shape
    changes = [(i, at, (new[i] - old[i])[at]) for i in range(k) for at in [np.flatnonzero(new[i] != old[i])] if len(at)]
    squares = (new * new).sum(1)
    schema = state.sparkSession.createDataFrame([], STATE).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, dots = table_of(batch["q"], dims), table_of(batch["dots"], k)
            for i, at, by in changes:
                dots[:, i] += x[:, at] @ by
            away = batch["norm"].to_numpy()[:, None] - 2 * dots + squares
            cluster = away.argmin(1)  # the first of equal ones
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], listed(x, pa.int32()), batch["norm"], listed(dots, pa.int64()), pa.array(cluster, pa.int32()),
                pa.array(away[np.arange(len(x)), cluster], pa.int64())], schema=arrow)

    return state.select("vec_id", "q", "norm", "dots").mapInArrow(task, schema)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept.

    `vectors`: vec_id, embedding. Vectors that are null, of another length, or hold a null or
    non-finite component take no part; a component beyond 2**26 / scale raises an error, because
    distances would no longer fit a long. The first centroids are the k vectors with the smallest
    SHA-256 of `seed:vec_id` (ids of repeated rows tie by components, a null id comes last);
    fewer vectors make fewer centroids. Repeated rows count as often as they stand there; equal
    distances go to the smaller number; a centroid without vectors stays where it is; an empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = whole(vectors, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "q").limit(k).collect()  # k rows
    new = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    if not len(new):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    state = kept.select("vec_id", "q", norm.alias("norm"), F.array_repeat(F.lit(0).cast("long"), len(new)).alias("dots"))
    state = cut(moved(state, np.zeros_like(new), new))
    for _ in range(rounds):
        old, new = new, new.copy()
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("q")[i].cast("long")) for i in range(dims)]).alias("sums"))
        for r in sums.collect():  # a row per centroid
            new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        state = cut(moved(state, old, new))
    totals = {r["cluster"]: r["total"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in new]
    ends = spark.createDataFrame([(c, t, digests[c]) for c, t in sorted(totals.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    return state.join(F.broadcast(ends), "cluster").select(  # a row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(totals.values())).cast("long").alias("inertia"), "centroid_sha256")


def clustered_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same over a view `embeddings`, in SQL."""
    parts = ["kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {s}) AS BIGINT)) AS q "
             "FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {d})",
             "c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q AS c FROM kept "
             "ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k})"]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT row, vec_id, q, cluster, CAST(list_sum(list_transform(range(1, {{d}} + 1), lambda j: (q[j] - c[j]) * (q[j] - c[j]))) AS BIGINT) AS distance FROM kept, c{i})")
        parts.append(f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY row)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, j, CAST(floor_div AS BIGINT) AS v FROM (SELECT cluster, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div "
                         f"FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, {{d}} + 1)) AS j FROM a{i}) GROUP BY cluster, j))")
            parts.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(any_value(m.c), any_value(c{i}.c)) AS c FROM c{i} LEFT JOIN "
                         f"(SELECT cluster, list(v ORDER BY j) AS c FROM s{i} GROUP BY cluster) m USING (cluster) GROUP BY c{i}.cluster)")
    last = f"""SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    return ("WITH " + ",\n".join(parts) + "\n" + last).format(s=scale, d=dims, k=k, seed=seed)
