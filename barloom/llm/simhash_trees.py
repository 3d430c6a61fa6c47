"""SimHash near-duplicates by vantage-point trees over distinct fingerprints.

Two fingerprints with at most 4 differing bits agree but for at most 1 bit in one of three
blocks of bits. Each block has a vantage-point tree: a node holds a vantage value and a
radius, and splits by Hamming distance within the block. A fingerprint lives in one leaf
(shard). As a query it descends with radius 1 and, by the triangle bound, enters every
branch its ball can reach, so it visits the shards its ball overlaps. Values one bit apart
differ in parity, so only odd values visit. Within a shard all 64 bits are compared, and a
spanning forest of the links found is kept: never all pairs of a group. Shards with many
rows are cut into blocks of bounded size. Links are joined by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, per_row, texts

NEAR = 4  # differing bits of a link
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
REACH = NEAR // len(BLOCKS)  # differing bits in the best block
SHARD = 512  # fingerprints a leaf should hold
DEPTH = 12  # deepest tree: what a task carries is bounded by 2**DEPTH nodes a block
PER_LEAF = 12  # sampled fingerprints a leaf of the tree is fitted on; the sample only shapes the tree
BLOCK_ROWS = 8192  # rows of a shard that one group compares


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, as a signed long; no words: 0."""
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    first, last = starts[:n].tolist(), ends[k - 1:].tolist()
    for at in range(0, n, 65536):
        part = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(first[at:at + 65536], last[at:at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed long) of each row; a null text counts as empty."""
    def make():
        return lambda rows: [{"doc_id": r["doc_id"], "fp": fingerprint(r["text"])} for r in rows]

    return per_row(texts(docs), make, "doc_id long, fp long")


class Tree:
    """A vantage-point tree of one block; node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, block: int, sample: np.ndarray, depth: int):
        self.block, self.depth = block, depth
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.radius = np.full(2**depth - 1, BLOCKS[block][1] // 2, np.int64)
        groups = [np.unique(self.part(sample))]
        for node in range(2**depth - 1):
            group = groups[node]
            inside = np.zeros(len(group), bool)
            if len(group) > 1:
                tries = group[:: max(1, len(group) // 8)][:8]
                best = None
                for v in tries:  # the vantage value whose median cut leaves the fewest on the boundary
                    d = np.bitwise_count(group ^ v).astype(np.int64)
                    mu = int(np.median(d))
                    both = np.count_nonzero((d >= mu) & (d <= mu + REACH)) + abs(np.count_nonzero(d <= mu) * 2 - len(d)) // 2
                    if best is None or both < best[0]:
                        best = both, v, mu, d
                _, self.vantage[node], self.radius[node], d = best
                inside = d <= self.radius[node]
            groups += [group[inside], group[~inside]]

    def part(self, fps: np.ndarray) -> np.ndarray:
        first, width = BLOCKS[self.block]
        return fps >> np.uint64(first) & np.uint64(2**width - 1)

    def home(self, fps: np.ndarray) -> np.ndarray:
        value, node = self.part(fps), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            outside = np.bitwise_count(value ^ self.vantage[node]) > self.radius[node]
            node = 2 * node + 1 + outside
        return node - (2**self.depth - 1)

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a query, leaf) for all leaves that a ball of radius REACH may overlap."""
        value = self.part(fps)
        who, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d, mu = np.bitwise_count(value[who] ^ self.vantage[node]).astype(np.int64), self.radius[node]
            inside, outside = d - REACH <= mu, d + REACH > mu
            who, node = np.concatenate([who[inside], who[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return who, node - (2**self.depth - 1)


def forest(queries: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """Links between queries and homes as edges that connect the same groups, at most one per row and merge."""
    label, edges = np.arange(len(homes)), []
    for at in range(0, len(queries), 128):
        some = queries[at:at + 128]
        near = np.bitwise_count(some[:, None] ^ homes[None, :]) <= NEAR
        near &= some[:, None] != homes[None, :]
        for i in np.flatnonzero(near.any(1)):
            hits = np.flatnonzero(near[i])
            names, first = np.unique(label[hits], return_index=True)
            edges += [(some[i], homes[hits[f]]) for f in first]
            if len(names) > 1:
                label[np.isin(label, names[1:])] = names[0]
    return edges


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect exactly what links connect. `distinct`: fp."""
    n = distinct.count()
    depth = max(0, min(DEPTH, (max(1, n // SHARD) - 1).bit_length()))
    size = PER_LEAF * 2**depth
    rows = distinct.sample(min(1.0, 1.2 * size / max(n, 1)), seed=7).limit(2 * size).collect()
    sample = np.sort(np.array([r["fp"] for r in rows], np.int64)).view(np.uint64)
    trees = [Tree(b, sample, depth) for b in range(len(BLOCKS))]

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for t in trees:
                yield pd.DataFrame({"shard": t.home(fps) + (t.block << depth)})

    crowded = {r["shard"]: -(-r["count"] // BLOCK_ROWS) for r in
               distinct.mapInPandas(homes, "shard long").groupBy("shard").count().filter(F.col("count") > BLOCK_ROWS).collect()}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each shard a fingerprint lives in or visits, per block of crowded shards."""
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for t in trees:
                home = t.home(fps)
                odd = np.flatnonzero(np.bitwise_count(t.part(fps)) & 1)
                who, leaf = t.visits(fps[odd])
                who = odd[who]
                away = leaf != home[who]
                who, leaf = np.concatenate([np.arange(len(fps)), who[away]]), np.concatenate([home, leaf[away]])
                frame = pd.DataFrame({"shard": leaf + (t.block << depth), "q": 0, "h": 0, "fp": fps[who].view(np.int64),
                                      "role": np.where(leaf == home[who], 3, 1)})
                split = frame["shard"].isin(crowded) if crowded else np.zeros(len(frame), bool)
                yield frame[~split]
                for shard, group in frame[split].groupby("shard"):
                    # A visitor and a row that lives here is a query in one row of the grid of blocks; the latter is also a home in one column.
                    side = crowded[shard]
                    mine = group["fp"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(side)
                    lives = group["role"].to_numpy() == 3
                    for k in range(side):
                        yield group.assign(q=mine.astype(np.int64), h=k, role=1)
                        yield group[lives].assign(q=k, h=mine[lives].astype(np.int64), role=2)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fps, role = group["fp"].to_numpy(np.int64).view(np.uint64), group["role"].to_numpy()
        edges = forest(fps[role & 1 > 0], fps[role & 2 > 0])
        return pd.DataFrame({"a": np.array([a for a, _ in edges], np.uint64).view(np.int64), "b": np.array([b for _, b in edges], np.uint64).view(np.int64)})

    return (distinct.mapInPandas(route, "shard long, q long, h long, fp long, role int")
            .groupBy("shard", "q", "h").applyInPandas(compare, "a long, b long")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node of an edge but the smallest of its component, with that smallest node.

    Alternates large-star and small-star; minima are aggregated before any join, rounds grow
    with the logarithm of the longest chain, and each round is written to the shared folder.
    """
    edges, before = cut(edges), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return edges
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = cut(small.filter("a <> b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Texts without words (null, empty) have fingerprint zero and link like any other; repeated
    rows give repeated rows; a null doc_id stays null and never names a component unless no
    document of it has an id; other columns are ignored.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = stars(links(distinct.select("fp")))
    rooted = distinct.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "fp")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
