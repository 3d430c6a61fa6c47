"""License scans by a positional index of rare words, in DataFrame operations only.

Templates are short notices. Every text is read once: what is kept of it are the places of words
that occur in templates, and the places of phrases. Document frequencies over the whole corpus
say which words of a template are rare; the index posts them with their positions. A file's
occurrences of indexed words meet the postings, and each votes for a relative position (its
place less the place in the template). Votes of a template that agree within SLACK words are
an alignment; it counts if the mandatory key phrases vote for the same relative position and
the words found hold enough of the rare words' weight (inverse document frequency). Index and
weights have a fixed number of rows, whatever the input; votes are aggregated per relative
position, so a text that repeats a notice costs a vote per word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut

# Phrases that always count, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices by label, and the phrases that must stand in them.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "any person obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "apache license 2 0", ("apache license 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
)
# Words that are never looked up.
COMMON = frozenset("a an and any are by for in into is of on or the this to use with without 0 4".split())
RARE = 5  # rarest words of a template that are indexed
SLACK = 8  # words by which relative positions may differ
SHARE = 0.6  # of the weight of a template's rare words
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = tuple(dict.fromkeys([p for p, _ in BASE] + [k for _, _, keys in TEMPLATES for k in keys]))
VOCABULARY = tuple(sorted({w for _, text, _ in TEMPLATES for w in text.split() if w not in COMMON} | {w for p in PHRASES for w in p.split()}))
NUMBER = {w: i + 1 for i, w in enumerate(VOCABULARY)}
BASE_BITS = (1 << len(BASE)) - 1  # base phrases come first


def phrases_at(word: Column, at: Column, place: Column) -> Column:
    """Bits of the phrases that start at an occurrence; `word` and `at` are arrays of all occurrences."""
    def stands(phrase: str) -> Column:
        words = phrase.split()
        met = F.get(word, place) == NUMBER[words[0]]
        for k, w in enumerate(words[1:], 1):
            met = met & (F.get(word, place + k) == NUMBER[w]) & (F.get(at, place + k) == F.get(at, place) + k)
        return F.coalesce(met, F.lit(False))

    bits = F.lit(0).cast("long")
    for k, phrase in enumerate(PHRASES):
        bits = bits + F.when(stands(phrase), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    starts = sorted({NUMBER[p.split()[0]] for p in PHRASES})
    return F.when(F.get(word, place).isin(starts), bits).otherwise(F.lit(0).cast("long"))


def read(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, occurrences of the vocabulary (at, word) and places of phrases (at, bits) of each row."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    split = docs.select("doc_id", words.alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    some = F.filter(placed, lambda x: F.lower(x["word"]).isin(list(VOCABULARY)))
    names = F.array(*[F.lit(w) for w in VOCABULARY])
    numbered = F.transform(some, lambda x: F.struct(x["at"].alias("at"), F.array_position(names, F.translate(x["word"], UPPER, LOWER)).cast("int").alias("word")))
    hits = split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(numbered, lambda x: x["word"] > 0).alias("hits"))
    hits = hits.select("doc_id", "n_words", F.col("hits.at").alias("at"), F.col("hits.word").alias("word"))
    starts = F.transform("at", lambda p, j: F.struct(p.alias("at"), phrases_at(F.col("word"), F.col("at"), j).alias("bits")))
    return hits.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "at", "word", F.filter(starts, lambda x: x["bits"] != 0).alias("places"))


def weights(rows: DataFrame) -> list[float]:
    """Inverse document frequency of each word of the vocabulary (a row a word reaches the driver)."""
    total = rows.count()
    found = dict(rows.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").count().collect())
    return [math.log((total + 1) / (found.get(i + 1, 0) + 0.5)) for i in range(len(VOCABULARY))]


def rarest(text: str, weight: list[float]) -> list[str]:
    """Words of a template to look up, the first of equally rare ones first."""
    words = [w for w in dict.fromkeys(text.split()) if w not in COMMON]
    return sorted(words, key=lambda w: -weight[NUMBER[w] - 1])[:RARE]


def index(weight: list[float]) -> tuple[list[tuple], list[tuple]]:
    """Postings (item, template, position, bit) of rare words and key phrases, and shares (template, bits, label, share) of accepted votes."""
    postings, shares = [], []
    for t, (label, text, keys) in enumerate(TEMPLATES):
        words, rare = text.split(), rarest(text, weight)
        for b, w in enumerate(rare):
            postings += [(NUMBER[w], t, i, 1 << b) for i, x in enumerate(words) if x == w]
        for b, key in enumerate(keys, len(rare)):
            k = key.split()
            postings += [(len(VOCABULARY) + 1 + PHRASES.index(key), t, i, 1 << b) for i in range(len(words)) if words[i:i + len(k)] == k]
        mass = [weight[NUMBER[w] - 1] for w in rare]
        every = ((1 << len(keys)) - 1) << len(rare)
        for bits in range(1 << len(rare)):
            share = sum(m for b, m in enumerate(mass) if bits >> b & 1) / sum(mass)
            if share >= SHARE:
                shares.append((t, bits | every, label, min(1.0, round(share, 6))))
    return postings, shares


def starts_with(phrase: int):
    """Tells whether a phrase starts at a place."""
    return lambda place: place["bits"].bitwiseAND(F.lit(1 << phrase).cast("long")) != 0


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of `docs`.

    The score is the largest share of a template's rare-word weight found with its key phrases
    at one relative position; a base phrase scores 1. A null text counts as empty: no words,
    no labels, score 0; repeated rows give repeated rows; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(read(docs))
    postings, shares = index(weights(rows))
    posted = F.broadcast(spark.createDataFrame(postings, "item int, template int, position int, bit long"))  # a row a posting
    accepted = F.broadcast(spark.createDataFrame(shares, "template int, bits long, label string, share double"))  # at most 2**RARE a template

    words = F.transform(F.arrays_zip("at", "word"), lambda x: F.struct(x["at"].alias("at"), x["word"].alias("item")))
    numbers = F.array(*[F.lit(k) for k in range(len(PHRASES))])
    keys = F.flatten(F.transform("places", lambda p: F.transform(
        F.filter(numbers, lambda k: F.call_function("getbit", p["bits"], k) == 1), lambda k: F.struct(p["at"].alias("at"), (k + (len(VOCABULARY) + 1)).alias("item")))))
    items = rows.filter(F.size("places") > 0).select("row", F.explode(F.concat(words, keys)).alias("x")).select("row", "x.at", "x.item")
    votes = items.join(posted, "item").withColumn("relative", F.col("at") - F.col("position"))
    grids = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("relative") + g) / SLACK).alias("place")) for g in (0, SLACK // 2)])).alias("grid")
    aligned = (votes.select("row", "template", "bit", grids).select("row", "template", "bit", "grid.grid", "grid.place")
               .groupBy("row", "template", "grid", "place").agg(F.bit_or("bit").alias("bits")))
    found = (aligned.join(accepted, ["template", "bits"]).groupBy("row")
             .agg(F.collect_set("label").alias("found"), F.max("share").alias("share")))

    base = F.filter("places", lambda p: p["bits"].bitwiseAND(BASE_BITS) != 0)
    n_base = F.aggregate("places", F.lit(0), lambda n, p: n + F.bit_count(p["bits"].bitwiseAND(BASE_BITS)))
    own = F.array_compact(F.array(*[F.when(F.exists("places", starts_with(k)), F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    out = rows.join(found, "row", "left").select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min(base["at"]).cast("long").alias("first_word"),
        F.array_max(base["at"]).cast("long").alias("last_word"), F.array_sort(own).alias("own"), "found", "share")
    every = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
                      F.array_join(every, ",").alias("labels"), score.alias("score"))


def licenses_sql() -> str:
    """The same over a view `documents`, in SQL."""
    def values(rows) -> str:
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

    template_words = [(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    key_places = []
    for t, (_, text, keys) in enumerate(TEMPLATES):
        words = text.split()
        key_places += [(t, key, i) for key in keys for i in range(len(words)) if words[i:i + len(key.split())] == key.split()]
    phrase_words = [(p, len(p.split()), i, w) for p in PHRASES for i, w in enumerate(p.split())]
    return f"""WITH rows AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
phrase(phrase, size, i, word) AS (VALUES {values(phrase_words)}),
template(template, i, word) AS (VALUES {values(template_words)}),
label(template, label) AS (VALUES {values((t, label) for t, (label, _, _) in enumerate(TEMPLATES))}),
key(template, phrase, i) AS (VALUES {values(key_places)}),
base(phrase, label) AS (VALUES {values(BASE)}),
word AS (SELECT row, n - 1 AS n, word FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS n FROM rows)
 WHERE word IN (SELECT word FROM template UNION SELECT word FROM phrase)),
place AS (SELECT row, phrase, n - i AS n FROM word JOIN phrase USING (word) GROUP BY row, phrase, n - i HAVING count(*) = any_value(size)),
weight AS (SELECT word, ln(((SELECT count(*) FROM rows) + 1) / (count(DISTINCT row) + 0.5)) AS weight
 FROM (SELECT DISTINCT word FROM template) LEFT JOIN word USING (word) GROUP BY word),
rare AS (SELECT template, word, weight FROM (SELECT template, word, min(i) AS i, any_value(weight) AS weight FROM template JOIN weight USING (word)
 WHERE word NOT IN ({", ".join(f"'{w}'" for w in sorted(COMMON))}) GROUP BY template, word)
 QUALIFY row_number() OVER (PARTITION BY template ORDER BY weight DESC, i) <= {RARE}),
vote AS (SELECT row, template, 'w:' || word AS item, n - i AS relative FROM word JOIN template USING (word) SEMI JOIN rare USING (template, word)
 UNION ALL SELECT row, template, 'k:' || phrase, place.n - key.i FROM place JOIN key USING (phrase)),
aligned AS (SELECT DISTINCT row, template, item, g, floor((relative + g) / {SLACK}.0) AS b FROM vote, (VALUES (0), ({SLACK // 2})) t(g)),
sums AS (SELECT row, template, g, b, count(*) FILTER (item LIKE 'k:%') AS keys, sum(coalesce(weight, 0)) AS mass
 FROM aligned LEFT JOIN (SELECT template, 'w:' || word AS item, weight FROM rare) USING (template, item) GROUP BY row, template, g, b),
found AS (SELECT row, list(DISTINCT label) AS found, max(least(1.0, round(mass / total, 6))) AS share FROM sums JOIN label USING (template)
 JOIN (SELECT template, count(DISTINCT phrase) AS needed FROM key GROUP BY template) USING (template)
 JOIN (SELECT template, sum(weight) AS total FROM rare GROUP BY template) USING (template)
 WHERE keys = needed AND mass / total >= {SHARE} GROUP BY row),
based AS (SELECT row, count(*) AS n_base, min(n) AS first_word, max(n) AS last_word, list(DISTINCT label) AS own FROM place JOIN base USING (phrase) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') AS labels,
 greatest(CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, coalesce(share, CAST(0 AS DOUBLE))) AS score
FROM rows LEFT JOIN based USING (row) LEFT JOIN found USING (row)"""
