"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors go to the list of their nearest centroid. A query probes the lists whose centroids
have the largest inner product with it. Within a list vectors lie rotated in blocks of
columns: after each block a hypothesis test on the partial distance, scaled to all
dimensions, abandons the candidates that will not reach the query's k-th best so far. The
nearest few lists are scanned first; their k-th best score bounds the scan of the others.
Scores of what survives are taken on the original vectors.

Centroids and the share of lists to probe are fitted on a bounded sample of vectors (FIT
rows): the share is the smallest whose recall on the sample reaches `target`. Every vector
is indexed. Lists and their queries are dealt in blocks of bounded size, so a list may hold
any share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut

FIT = 20_000  # sampled vectors that fit centroids and the probed share; bounded, does not grow
LISTS = 1024  # most lists
PER_LIST = 1024  # vectors a list should hold
COLUMNS = 16  # dimensions of a block
TRUST = 2.1  # how many standard errors the test allows
BLOCK_ROWS = 4096  # vectors, and queries, that one group compares
FIRST = 4  # lists whose best scores bound the search of the others
SLACK = 1e-9  # of bounds, for sums in another order


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


class Lists:
    """Centroids and the number of lists a query probes."""

    def __init__(self, sample: np.ndarray, total: int, k: int, target: float):
        rng = np.random.default_rng(5)
        n = max(1, min(LISTS, total // PER_LIST, len(sample) // 8))
        self.centroids = sample[rng.choice(len(sample), n, replace=False)]
        for _ in range(8):
            home = self.home(sample)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, home, sample)
            count = np.bincount(home, minlength=n)[:, None]
            self.centroids = np.where(count > 0, sums / np.maximum(count, 1), self.centroids)
        home, asked = self.home(sample), rng.choice(len(sample), min(500, len(sample)), replace=False)
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        top = np.argsort(-scores, axis=1)[:, :max(1, min(k, len(sample) - 1))]
        order = self.order(sample[asked])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[None, :], 1)
        needed = np.sort(np.take_along_axis(place, home[top], 1).ravel()) + 1
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(2 * x @ self.centroids.T - (self.centroids**2).sum(1), 1)

    def order(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")

    def probed(self, queries: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, list, turn): `probes` lists each, more where they hold no more than k vectors.

        The first lists, FIRST of them or what it takes to hold more than k, are scanned in turn 1.
        """
        order = self.order(queries)
        held = np.cumsum(sizes[order], axis=1)
        enough = np.minimum((held <= k).sum(1) + 1, order.shape[1])
        place = np.broadcast_to(np.arange(order.shape[1]), order.shape)
        keep = place < np.maximum(self.probes, enough)[:, None]
        turn = np.where(place < np.maximum(FIRST, enough)[:, None], 1, 2)
        return np.nonzero(keep)[0], order[keep], turn[keep]


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))[0]


class ColumnBlocks:
    """The vectors of one group, rotated, as blocks of columns with norms."""

    def __init__(self, x: np.ndarray):
        d = x.shape[1]
        self.d, self.x, self.turn = d, x, rotation(d)
        y = x @ self.turn
        self.edges = [*range(0, d, COLUMNS), d]
        self.blocks = [np.ascontiguousarray(y[:, a:b]) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.seen = list(np.cumsum([(b**2).sum(1) for b in self.blocks], axis=0))  # squared length in the first blocks

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, unique: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the candidates that survive for a few queries at a time, with all that reach `least`.

        `own` masks out a query's own row; `least` is a lower bound of its k-th best score. It is
        raised by k rows of the group only if these are `unique`, k different ids.
        """
        turned = queries @ self.turn
        lengths = (turned**2).sum(1)
        dots = turned[:, :self.edges[1]] @ self.blocks[0].T
        if unique and len(self.x) > 2 * k:  # k exact scores of likely ones: the k-th best is no worse than their least
            likely = np.argpartition(np.where(own, np.inf, -dots), k - 1, axis=1)[:, :k]
            scores = np.where(np.take_along_axis(own, likely, 1), -np.inf, np.einsum("qkd,qd->qk", self.x[likely], queries))
            least = np.maximum(least, scores.min(1) - SLACK)
        q, row = np.nonzero(~own)
        dots, parts = dots[q, row], np.zeros(len(q))
        for i, block in enumerate(self.blocks):
            a, b = self.edges[i], self.edges[i + 1]
            if i:
                dots = dots + np.einsum("nd,nd->n", block[row], turned[q, a:b])
            seen = (turned[:, :b]**2).sum(1)
            parts = self.seen[i][row] + seen[q] - 2 * dots
            if b < self.d:
                far = np.maximum(self.seen[-1][row] + lengths[q] - 2 * least[q], 0)
                stays = np.maximum(parts, 0) * (self.d / b) <= far * (1 + TRUST / np.sqrt(b)) ** 2
                q, row, dots = q[stays], row[stays], dots[stays]
        stays = dots >= least[q]
        q, row = q[stays], row[stays]
        return q, row, (self.x[row] * queries[q]).sum(1)


def scan(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best vectors of one group for each of its queries: at most k each, none below the query's bound."""
    found: list[pd.DataFrame] = []
    if len(queries) and len(vectors):
        ids, blocks = vectors["vec_id"].to_numpy(), ColumnBlocks(matrix(vectors["v"]))
        unique = len(np.unique(ids)) == len(ids)
        for at in range(0, len(queries), 32):
            some = queries.iloc[at:at + 32]
            asked = some["query_id"].to_numpy()
            q, row, score = blocks.search(matrix(some["v"]), asked[:, None] == ids[None, :], some["least"].to_numpy(), k, unique)
            if not unique:  # the best vector of each id
                order = np.lexsort((-score, ids[row], q))
                q, row, score = q[order], row[order], score[order]
                first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[row[1:]] != ids[row[:-1]])])[:len(q)]
                q, row, score = q[first], row[first], score[first]
            best = np.lexsort((ids[row], -score, q))
            q, row, score = q[best], row[best], score[best]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append(pd.DataFrame({"query_id": asked[q[keep]], "vec_id": ids[row[keep]], "score": score[keep]}))
    if not found:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
    return pd.concat(found).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product, ties to the smaller vec_id.

    Both inputs have vec_id and embedding. Vectors without id, unusable ones (see `usable`)
    and those of another dimension than most take no part. Rows repeated under one id count
    once, of different vectors under one id the best; a query is never its own answer. With fewer than k candidates all are returned;
    without usable vectors nothing is.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").alias(name), F.col("embedding").alias("v"))

    out = "query_id long, rank int, vec_id long, score double"
    base = clean(vectors, "vec_id")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    base, asked = (df.filter(F.size("v") == sizes["d"]) for df in (base, clean(queries, "query_id")))
    rows = base.select("vec_id", "v").sample(min(1.0, 1.2 * FIT / sizes["count"]), seed=3).limit(FIT).collect()
    rows = rows or base.limit(FIT).collect()
    rows = sorted({(r["vec_id"], tuple(r["v"])) for r in rows})
    lists = Lists(np.array([v for _, v in rows], np.float64), sizes["count"], k, target)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(list=lists.home(matrix(b["v"])) if len(b) else pd.Series([], dtype="int64"))

    kind, asked_kind = (df.schema["v"].dataType.simpleString() for df in (base, asked))  # components stay as exact as they came
    placed = cut(base.dropDuplicates(["vec_id", "v"]).mapInPandas(place, f"vec_id long, v {kind}, list long"))
    n = len(lists.centroids)
    held, ids = np.zeros((2, n), np.int64)
    for r in placed.groupBy("list", "vec_id").count().groupBy("list").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("ids")).collect():  # at most LISTS rows
        held[r["list"]], ids[r["list"]] = r["rows"], r["ids"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at:at + 256]
                who, where, turn = lists.probed(matrix(some["v"]), ids, k)
                yield some.iloc[who].assign(list=where, turn=turn)

    probed = asked.mapInPandas(probe, f"query_id long, v {asked_kind}, list long, turn int")
    wanted = np.zeros((3, n), np.int64)
    counts = asked.mapInPandas(lambda batches: (p[["list", "turn"]] for p in probe(batches)), "list long, turn int").groupBy("list", "turn").count()
    for r in counts.collect():  # at most twice LISTS rows
        wanted[r["turn"], r["list"]] = r["count"]

    def grid(df: DataFrame, key: str, own: str, other: str, mine: np.ndarray, others: np.ndarray) -> DataFrame:
        """A row's own block of its list, and a copy for each block of the other side."""
        def parts(count):
            return F.array(*[F.lit(int(max(1, -(-c // BLOCK_ROWS)))) for c in count])[F.col("list").cast("int")]
        return (df.withColumn(own, F.pmod(F.xxhash64(key), parts(mine)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), parts(others) - 1).cast("array<bigint>"))))

    def scanned(bounded: DataFrame, turn: int) -> DataFrame:
        left = grid(bounded, "query_id", "qb", "vb", wanted[turn], held).groupBy("list", "qb", "vb")
        right = grid(placed, "vec_id", "vb", "qb", held, wanted[turn]).groupBy("list", "qb", "vb")
        return left.cogroup(right).applyInPandas(lambda q, v: scan(q, v, k), "query_id long, vec_id long, score double")

    def best(near: DataFrame) -> DataFrame:
        near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    first = cut(best(scanned(probed.filter("turn = 1").withColumn("least", none), 1)))
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - SLACK).otherwise(none).alias("least"))
    rest = probed.filter("turn = 2").join(bound, "query_id", "left").withColumn("least", F.coalesce("least", none))
    both = scanned(rest, 2).unionByName(first.drop("rank"))
    return best(both).select("query_id", "rank", "vec_id", "score")
