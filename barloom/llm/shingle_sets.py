"""Near-duplicates by SimHash and by Jaccard similarity of word shingles.

Contents (distinct texts) meet where their SimHash fingerprints are equal or linked by the
vantage-point trees of `simhash_trees` (4 or fewer differing bits), which finds the closest
ones. Similar texts differ in more bits than that, so contents also meet where one of BANDS bands of ROWS minimum hashes agrees: at the
similarity asked for, a pair misses all bands with probability (1 - 0.8**5)**20 = 0.0004, and more
similar ones less often. Every link is checked on the whole shingle sets. In a band members
are compared with its leader first, the one that meets most others, then what is outside the
band's largest component with the member of it that shares most of its set. What is still
outside may link to members of other components: only shingles that occur in several
components can be shared, their number and the sizes rule out nearly all such pairs, and the
others meet on their rarest shared shingles. Both bounds are exact, so each band connects what
its similar pairs connect, and a group of copies costs a few links per row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, parted, per_row
from barloom.llm.simhash_trees import fingerprint, links, stars

WIDTH = 5  # words of a shingle
SIMILAR = 0.8
BANDS, ROWS = 20, 5
CHUNK = 4096  # shingles hashed at a time
_draw = np.random.default_rng(13).integers(0, 2**64, (3, BANDS * ROWS), np.uint64)
TIMES, PLUS, MIX = _draw[0] | np.uint64(1), _draw[1], _draw[2].reshape(BANDS, ROWS) | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    pairs = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(line[a:b]) for a, b in pairs], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed long for each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (TIMES[:, None] * hashes[None, at:at + CHUNK] + PLUS[:, None]).min(1))
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def contents(docs: DataFrame) -> DataFrame:
    """key (of the text) and text of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. `sets`: key, shingles; only sets of the pairs are moved."""
    sets = sets.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key", "left_semi")
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - common
    return both.filter((either == 0) | (common / either >= SIMILAR)).select("a", "b")


def possible(size: Column, shared: Column, other_size: Column, other_shared: Column) -> Column:
    """Whether two sets can be similar enough if at most `shared` of their members are shared."""
    return F.least(shared, other_shared) * (1 + SIMILAR) + 1e-9 >= (size + other_size) * SIMILAR


def mixed(rooted: DataFrame) -> DataFrame:
    """Rows (place, band, key, root, ...) of bands with several roots, with `most`, the one with most rows."""
    parts = rooted.groupBy("place", "band", "root").agg(F.count(F.lit(1)).alias("n"))
    several = (parts.groupBy("place", "band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root"))["root"].alias("most"))
               .filter("parts > 1").drop("parts"))
    return rooted.join(several, ["place", "band"])


def others(members: DataFrame) -> DataFrame:
    """Rows outside the largest component of their band, by other names."""
    return members.filter("root <> most").select("place", "band", *[F.col(c).alias(f"other_{c}") for c in ("key", "root", "size", "shared")])


def may_link() -> Column:
    return possible(F.col("size"), F.col("shared"), F.col("other_size"), F.col("other_shared"))


def bounded(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`members` with the size of each set and how many of its shingles occur under several roots; those shingles with their frequency."""
    roots = members.select("key", "root").distinct()
    spread = sets.join(roots, "key").select("key", "root", F.explode("shingles").alias("shingle")).repartition("shingle")
    same = Window.partitionBy("shingle")  # shingles move once
    several = cut(spread.select("key", "shingle", F.min("root").over(same).alias("one"), F.max("root").over(same).alias("two"), F.count(F.lit(1)).over(same).alias("df"))
                  .filter("one <> two").select("key", "shingle", "df"))
    common = several.select("shingle", "df").distinct()
    shared = several.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    sized = sets.join(roots, "key", "left_semi").select("key", F.size("shingles").alias("size")).join(shared, "key", "left")
    return cut(members.join(sized.withColumn("shared", F.coalesce("shared", F.lit(0))), "key")), common


def best_links(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of what is outside and the member of the largest component that shares most of its set."""
    leader = F.max(F.struct((F.col("shared") / F.greatest("size", F.lit(1))).alias("part"), "key", "size", "shared")).alias("x")
    leaders = members.filter("root = most").groupBy("place", "band").agg(leader).select("place", "band", "x.key", "x.size", "x.shared")
    return (others(members).join(leaders, ["place", "band"]).filter(may_link())
            .select(F.greatest("key", "other_key").alias("a"), F.least("key", "other_key").alias("b")).distinct())


def prefix_links(members: DataFrame, sets: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may still be similar enough.

    For each size that occurs in its band, a set outside must share `need` shingles with a
    partner of that size, so at least one of its `shared - need + 1` rarest shared ones: those
    are looked up, never a whole band.
    """
    sizes = members.groupBy("place", "band", "size").agg(F.max("shared").alias("shared"))
    reach = cut(others(members).join(sizes, ["place", "band"]).filter(may_link()).drop("shared"))
    near = members.join(reach.select("place", "band").distinct(), ["place", "band"], "left_semi")  # bands with something left to look up
    reach = reach.drop("place", "band").distinct()
    own = (sets.join(reach.select(F.col("other_key").alias("key")), "key", "left_semi").select(F.col("key").alias("other_key"), F.explode("shingles").alias("shingle"))
           .join(common, "shingle").groupBy("other_key").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare")))  # at most a set
    need = F.ceil((F.col("other_size") + F.col("size")) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    first = F.slice("rare", F.lit(1), F.greatest(F.size("rare") - need + 1, F.lit(0)).cast("int"))
    asked = reach.join(own, "other_key").select("other_key", "other_root", "other_size", "other_shared", "size", F.explode(first).alias("x")).withColumn("shingle", F.col("x.shingle")).drop("x")
    held = sets.join(near.select("key", "root", "size", "shared").distinct(), "key").select("key", "root", "size", "shared", F.explode("shingles").alias("shingle"))
    return (held.join(asked, ["shingle", "size"]).filter((F.col("root") != F.col("other_root")) & may_link())
            .select(F.greatest("key", "other_key").alias("a"), F.least("key", "other_key").alias("b")).distinct())


def close(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of contents that connect what equal and linked SimHash fingerprints connect. `prints`: key, fp."""
    named = cut(prints.groupBy("fp").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("n")))
    equal = prints.join(named.filter("n > 1"), "fp").filter("key <> name").select(F.col("key").alias("a"), F.col("name").alias("b"))
    near = (links(named.select("fp")).join(named.select(F.col("fp").alias("a"), F.col("name").alias("x")), "a")
            .join(named.select(F.col("fp").alias("b"), F.col("name").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return cut(equal.union(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def joined(star: DataFrame, links: DataFrame) -> DataFrame:
    """Components of a star and further links."""
    links = cut(links)
    return star if links.isEmpty() else stars(star.union(links))


def components(docs: DataFrame) -> DataFrame:
    """key, root: contents in a component of several, with the component's smallest key. Other contents are left out.

    A null text counts as empty; texts without words are alike; repeated rows are one content;
    an empty table gives no rows; other columns are ignored.
    """
    def banded():
        return lambda rows: [{"key": r["key"], "fp": fingerprint(r["text"]), "bands": bands(shingles(r["text"])).tolist()} for r in rows]

    def whole():
        return lambda rows: [{"key": r["key"], "shingles": shingles(r["text"]).view(np.int64).tolist()} for r in rows]

    prints = cut(per_row(contents(docs), banded, "key long, fp long, bands array<long>").dropDuplicates(["key"]))
    rows = prints.select("key", F.posexplode("bands").alias("place", "band")).repartition("place", "band")  # counted and joined in place
    crowds = rows.groupBy("place", "band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = cut(rows.join(crowds, ["place", "band"]))
    fame = cut(crowd.groupBy("key").agg(F.sum("n").alias("fame")))
    simhash = close(prints.select("key", "fp"))
    met = cut(fame.select("key").union(simhash.select("a")).union(simhash.select("b")).distinct())
    some, _ = parted(contents(docs), F.col("key"), met)  # other texts stay where they are
    one_each = some.join(met, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = cut(per_row(one_each, whole, "key long, shingles array<long>"))

    leaders = crowd.join(fame, "key").groupBy("place", "band").agg(F.max(F.struct("fame", "key"))["key"].alias("leader"))
    led = cut(crowd.join(leaders, ["place", "band"]).filter("key <> leader")
              .select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b")).union(simhash).distinct())
    star = stars(similar(led, sets))

    def rooted(rows, star):
        return rows.join(star.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))

    members, common = bounded(cut(mixed(rooted(crowd.select("place", "band", "key"), star))), sets)
    star = joined(star, similar(cut(best_links(members).join(led, ["a", "b"], "left_anti")), sets))
    members = cut(mixed(rooted(members.drop("root", "most"), star)))
    star = joined(star, similar(cut(prefix_links(members, sets, common).join(led, ["a", "b"], "left_anti")), sets))
    return star.select(F.col("a").alias("key"), F.col("b").alias("root"))
