"""License scans against a plain version and their SQL."""

import math
import random
import re

import duckdb
import pytest

from barloom.llm import license_index, queries
from barloom.llm.license_index import BASE, COMMON, RARE, SHARE, SLACK, TEMPLATES
from tests.llm.conftest import SMALL
from tests.llm.test_tokens import bag

PLANTED = ["Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license. Licensed under CC BY-NC 4.0", "under the  K mit-license",
           "Licensed under the Apache License, Version 2.0", "the Apache License; version2", "Apache License 2.0 here", "under the GNU General Public License, version 3.",
           "gnu general public things. license version 3", "License under gnu " + "x " * 40 + "general public license version 3", "mit license mit license " * 400,
           "This work is licensed under Creative Commons Attribution-NonCommercial license", "under the mit lİcense", "under the mït license", "CC BY NC cc by nc cc by nc",
           " ".join(t for _, t, _ in TEMPLATES), "redistribution and use in source and binary forms, with or without modification"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def plain(rows):
    split = [(i, words_of(t)) for i, t in rows]
    sets = [set(w) for _, w in split]
    weight = {w: math.log((len(rows) + 1) / (sum(w in s for s in sets) + 0.5)) for _, t, _ in TEMPLATES for w in t.split()}
    out = []
    for doc, words in split:
        at = sorted(i for p, _ in BASE for i in places(words, p))
        own = {label for p, label in BASE if places(words, p)}
        found, best = set(own), 1.0 if own else 0.0
        for label, text, keys in TEMPLATES:
            t = text.split()
            rare = sorted((w for w in dict.fromkeys(t) if w not in COMMON), key=lambda w: -weight[w])[:RARE]
            votes = {}
            for i, w in enumerate(words):
                for j, x in enumerate(t):
                    if w == x and w in rare:
                        votes.setdefault(i - j, set()).add(w)
            for key in keys:
                for i in places(words, key):
                    for j in places(t, key):
                        votes.setdefault(i - j, set()).add(("key", key))
            for grid in (0, SLACK // 2):
                buckets = {}
                for d, names in votes.items():
                    buckets.setdefault((d + grid) // SLACK, set()).update(names)
                for names in buckets.values():
                    share = sum(weight[w] for w in rare if w in names) / sum(weight[w] for w in rare)
                    if all(("key", k) in names for k in keys) and share >= SHARE:
                        found.add(label)
                        best = max(best, min(1.0, round(share, 6)))
        out.append((doc, len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(own)), ",".join(sorted(found)), best))
    return out


@pytest.fixture(scope="module")
def docs(spark, everything):
    rng = random.Random(9)
    pool = [w for _, t, _ in TEMPLATES for w in t.split()] + ["x", "Mit", "LICENSE"]
    texts = PLANTED + [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(40)]
    texts += [" ".join(rng.choice(TEMPLATES)[1].split()[rng.randrange(3):]) for _ in range(40)]
    return everything.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()


def test_plain(docs):
    got = license_index.licenses(docs).collect()
    assert bag(got) == bag(plain([(r.doc_id, r.text) for r in docs.collect()]))
    by = {r.doc_id: r for r in got}
    assert by[9006].labels == "gpl-3" and by[9006].base_labels == "" and by[9008].labels == "" and by[9011].labels == "" and by[9001].n_base == 3
    assert all(label in by[9014].labels for label, _, _ in TEMPLATES)


def test_odd(odd, nothing):
    assert license_index.licenses(nothing).count() == 0
    assert license_index.licenses(odd.withColumn("at", odd["row"]).withColumn("words", odd["row"])).count() == odd.count()


def test_registered_and_sql(spark, docs, tmp_path):
    for folder in (SMALL, str(tmp_path)):
        if folder != SMALL:
            docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        got = queries.QUERIES["op12_license_index"](spark, folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if folder != SMALL else ''}'")
        twin = con.execute(queries.SQL["op12_license_index"])
        names = [d[0] for d in twin.description]
        rows = [dict(zip(names, r, strict=True)) for r in twin.fetchall()]
        assert sorted(names) == sorted(got.columns)
        assert bag(got.collect()) == bag(tuple(r[c] for c in got.columns) for r in rows)
