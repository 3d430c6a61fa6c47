"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from barloom.llm import queries, spelling_frontier
from tests.llm.test_tokens import bag


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        some = {w[:i] + w[i + 1:] for i in range(len(w))}
        if len(w) < 100:
            some |= {w[:i] + c + w[i + j:] for i in range(len(w) + 1) for c in letters for j in (0, 1)}
        else:
            some |= {x for x in words if len(x) == len(w) and sum(a != b for a, b in zip(w, x, strict=True)) == 1}
            some |= {x for x in words if len(x) == len(w) + 1 and any(x[:i] + x[i + 1:] == w for i in range(len(x)))}
        near[w] = sorted((some & words.keys()) - {w}, key=lambda x: (-words[x], x))
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 5 * n else None for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def made(n, rng):
    """Texts of words and their variants, frequent and rare ones, with chains of forms."""
    texts, letters = [], "abcé"
    for i in range(n):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 11)))
        times = 700
        while times:
            texts.append(" ".join([word] * times))
            at, c = rng.randrange(len(word) + 1), rng.choice(letters)
            word, times = word[:at] + c * rng.randrange(2) + word[at + rng.randrange(2):], times // rng.choice((3, 5, 6))
    return texts


@pytest.mark.parametrize("hot", [20_000, 3])
def test_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling_frontier, "HOT", hot)
    rows = list(enumerate(made(150, random.Random(hot))))
    long = "q" * 80
    rows += [(9000, " ".join([long, long + "q", long[:-1] + "r", "r" + long] * 5 + [long] * 60)), (9001, ("ab" * 32 + " " + "ab" * 31 + "a " + "ab" * 32 + "a ") * 6)]
    rows += [(None, None), (None, "Wörter WÖRTER wörter " * 4 + "wörten "), (9002, ""), (9003, "×÷×÷×÷ " * 7)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, node string")
    got = spelling_frontier.variants(frame).collect()
    expected = plain(rows)
    assert bag(got) == bag(expected)
    assert any(r[2] != r[1] and r[1] for r in expected) and any(r[4] > 1 for r in expected)


def test_registered(spark, everything, tmp_path):
    everything.union(everything).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_spelling_frontier"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert bag(got.collect()) == bag(plain([(r.doc_id, r.text) for r in everything.collect()] * 2))


def test_empty(nothing):
    assert spelling_frontier.variants(nothing).count() == 0
