"""Spelling variant grouping by a frontier of trie states that are joined level by level.

Words are the corpus's frequent letter runs. Their prefixes are the nodes of a trie, a
distributed table of edges; a second trie holds the reversed words. A state (word, node, rest)
says that a word with one edit spent so far reached a node, with the rest of it still to read.
States are born where the path of another word leaves the own one: a letter replaced, inserted
or deleted at a node. Two words one edit apart agree on the first half of one of them or on
what follows it, so the trie of words bears edits from the middle on and that of reversed words
the others: no state starts near a root, where every word would meet every branch. Each level
joins the frontier with the edges once more; states that read their whole word on a node that
is a word are neighbours.

Levels are bounded by half of LONG letters. Longer words, which would need a level a letter,
meet by the hashes of what one deletion leaves of them, and every such pair is compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut

RUN = re.compile("[A-Za-zÀ-ÿ]{6,}")  # runs are maximal; shorter ones never give a word of 6
LEAST, OFTEN = 6, 5  # code points and occurrences of a word
DROP = 199
TIMES = 5  # how much more frequent a form is
LONG = 64  # longest words of the tries
FLUSH = 300_000  # distinct words a task holds before it passes them on
HOT = 20_000  # words below a node from which on it is copied
PRIME = (1 << 61) - 1


def counted(docs: DataFrame) -> DataFrame:
    """word and n of all words of the texts."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def passed():
            yield pd.DataFrame({"word": list(held), "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DROP == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < LEAST:
                            continue
                    held[run] += n
                if len(held) > FLUSH:
                    yield from passed()
        yield from passed()

    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return texts.mapInPandas(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


def births(spelled: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """side, word, node, rest after the one edit at any position from `start` on. `nodes`: side, node, kids (its letters), copies."""
    at = spelled.select("side", "word", "s", F.explode(F.sequence("start", F.length("s"))).alias("k"))
    at = at.select("side", "word", F.substring("s", F.lit(1), F.col("k")).alias("node"), F.substring("s", F.col("k") + 1, F.length("s")).alias("rest"))
    at = at.join(F.broadcast(hot), ["side", "node"], "left")  # at most a node per HOT words and depth
    at = at.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("word"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    dealt = nodes.join(F.broadcast(hot), ["side", "node"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int") - 1)))
    met = at.join(dealt.select("side", "node", "salt", "kids"), ["side", "node", "salt"])
    first, more = F.substring("rest", 1, 1), F.substring("rest", F.lit(2), F.length("rest"))
    others = F.filter("kids", lambda c: c != first)

    def state(node, rest):
        return F.struct(node.alias("node"), rest.alias("rest"))

    none = F.array().cast("array<struct<node:string,rest:string>>")
    inserted = F.transform(others, lambda c: state(F.concat("node", c), F.col("rest")))
    replaced = F.when(first != "", F.transform(others, lambda c: state(F.concat("node", c), more))).otherwise(none)
    deleted = F.when((first != "") & (F.substring("rest", 2, 1) != first), F.array(state(F.col("node"), more))).otherwise(none)
    return met.select("side", "word", F.explode(F.concat(inserted, replaced, deleted)).alias("x")).select("side", "word", "x.node", "x.rest")


def near_words(words: DataFrame) -> DataFrame:
    """word, near: all pairs of words of at most LONG code points that are one edit apart, both ways."""
    half = F.floor(F.length("word") / 2).cast("int")
    sides = F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("word").alias("s"), half.alias("start")),
                              F.struct(F.lit("b").alias("side"), F.reverse("word").alias("s"), (F.length("word") - half).alias("start")))).alias("x")
    spelled = words.filter(F.length("word") <= LONG).select("word", sides).select("word", "x.*")
    path = spelled.select("side", "s", F.explode(F.sequence(F.lit(LEAST // 2), F.length("s") - 1)).alias("k"))
    edges = cut(path.groupBy("side", F.substring("s", F.lit(1), F.col("k")).alias("node"), F.substring("s", F.col("k") + 1, F.lit(1)).alias("kid"))
                .agg(F.count(F.lit(1)).alias("words")))
    nodes = edges.groupBy("side", "node").agg(F.collect_list("kid").alias("kids"))  # at most a kid per letter
    hot = (edges.groupBy("side", "node").agg(F.sum("words").alias("words")).filter(F.col("words") > HOT)
           .select("side", "node", F.ceil(F.col("words") / HOT).alias("copies")))
    reached = edges.select("side", F.concat("node", "kid").alias("node"))

    frontier, ends = cut(births(spelled, nodes, cut(hot))), []
    while True:
        ends.append(frontier.filter("rest = ''").select("side", "word", "node"))
        walking = frontier.filter("rest <> ''")
        step = walking.select("side", "word", F.concat("node", F.substring("rest", 1, 1)).alias("node"), F.substring("rest", F.lit(2), F.length("rest")).alias("rest"))
        frontier = cut(step.join(reached, ["side", "node"], "left_semi"))
        if frontier.isEmpty():
            break
    found = ends[0]
    for more in ends[1:]:
        found = found.union(more)
    found = found.select("word", F.when(F.col("side") == "f", F.col("node")).otherwise(F.reverse("node")).alias("near"))
    return found.join(words.select(F.col("word").alias("near")), "near", "left_semi").distinct()


def remains(text: str) -> np.ndarray:
    """Hashes of the word itself (last) and of what is left of it after each deletion, by prefix sums of a polynomial."""
    codes, base = [ord(c) for c in text], 1_000_003
    power, before = [1], [0]
    for c in codes:
        before.append((before[-1] + c * power[-1]) % PRIME)
        power.append(power[-1] * base % PRIME)
    whole = before[-1]
    back = pow(base, -1, PRIME)
    return np.array([(before[i] + (whole - before[i + 1]) * back) % PRIME for i in range(len(codes))] + [whole], np.int64)


def near_long_words(words: DataFrame) -> DataFrame:
    """word, near: pairs of words of at least LONG code points that are one edit apart, both ways."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for word in batch["word"]:
                hashes = remains(word)
                some = pd.DataFrame({"size": len(word) - 1, "hash": np.unique(hashes[:-1])})
                own = pd.DataFrame({"size": [len(word)], "hash": hashes[-1:]})
                yield pd.concat([some, own]).assign(word=word)

    left = words.filter(F.length("word") >= LONG).select("word").mapInPandas(task, "size long, hash long, word string")
    left = left.select("size", "hash", F.xxhash64("word").alias("key"))
    a, b = left.withColumnRenamed("key", "a"), left.withColumnRenamed("key", "b")
    pairs = a.join(b, ["size", "hash"]).filter("a <> b").select("a", "b").distinct()
    texts = words.filter(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("key"))
    both = (pairs.join(texts.select(F.col("word"), F.col("key").alias("a")), "a").join(texts.select(F.col("word").alias("near"), F.col("key").alias("b")), "b"))
    return both.filter("word <> near").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word.

    `docs`: doc_id, text. A null text has no words; a null doc_id counts as an empty one where
    deletions are drawn; repeated rows count as often as they stand there; equal frequencies go
    to the smaller word in code-point order; an empty table gives no rows; other columns are
    ignored. A form is at least TIMES as frequent as its word, so a chain of forms has at most
    27 steps, and five rounds of doubling reach its end.
    """
    words = cut(counted(docs))
    pairs = near_words(words)
    if not words.filter(F.length("word") >= LONG).isEmpty():
        pairs = pairs.union(near_long_words(words)).distinct()
    met = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    summed = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = F.col("n") * TIMES <= -F.col("best.n")
    out = cut(words.join(summed, "word", "left").select(
        "word", F.when(far, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.n")).alias("form_n")))
    ends = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        further = cut(further)
        ends = further.select("word", "root")
        if further.filter("went").isEmpty():
            break
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
