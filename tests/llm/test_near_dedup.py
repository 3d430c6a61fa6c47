"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from barloom.llm import shingle_sets
from barloom.llm.simhash_trees import fingerprint
from tests.llm.conftest import SMALL


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """(doc_id, text) rows: the smallest id of each component."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_stage_is_jaccard(spark):
    rng, rows = random.Random(4), []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [base] + [edited(base, rng.randrange(1, 9), rng) for _ in range(rng.randrange(4))]
    hub = [f"h{i}" for i in range(300)]
    rows += [edited(hub, 3, rng) for _ in range(60)] + [hub]  # copies of one text that are less alike among themselves
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)


def test_stage_on_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.filter("text IS NOT NULL").collect()]
    assert kept(spark, rows) == plain_kept(rows)


def test_far_copies_make_few_pairs(spark):
    """Copies of one text with many edits of their own meet nobody but the leader of their band."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = [base] + [edited(base, rng.randrange(2, 14), rng) for _ in range(300)]
    rows += [rows[-1][:-1] + ["z1"], rows[-2][:-1] + ["z2"]]  # two that link to nothing but each other's neighbour
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    counts = []
    plain = shingle_sets.prefix_links

    def watched(members, sets, common):
        pairs = plain(members, sets, common)
        counts.append((pairs.count(), sets.count()))
        return pairs

    shingle_sets.prefix_links = watched
    try:
        shingle_sets.components(docs).count()
    finally:
        shingle_sets.prefix_links = plain
    assert counts[0][0] <= counts[0][1] / 10


def test_links_between_components(spark):
    """Chains, bridges and families that share edits: what no leader meets is still found."""
    rng, rows = random.Random(31), []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(120)]
        pool = [f"edit{f}x{i}" for i in range(6)]
        for _ in range(25):
            out = list(base)
            for i in rng.sample(range(0, 120, 6), rng.randrange(0, 7)):
                out[i] = rng.choice(pool)
            rows.append(out[:rng.randrange(100, 121)])
        rows.append([f"f{f}y{i}" for i in range(40)] + base[:60])  # shares a passage
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)


def test_simhash_takes_part(spark, monkeypatch):
    """The stage asks the SimHash trees, and their pairs connect what 4 differing bits connect."""
    rng, asked = random.Random(17), []
    texts = []
    for f in range(30):
        base = [f"f{f}w{i}" for i in range(150)]
        texts += [" ".join(edited(base, n, rng)) for n in (0, 1, 1, 2)]
    plain = shingle_sets.close

    def watched(prints):
        asked.append((prints, plain(prints)))
        return asked[-1][1]

    monkeypatch.setattr(shingle_sets, "close", watched)
    assert kept(spark, list(enumerate(texts))) == plain_kept(list(enumerate(texts)))
    prints, pairs = ([tuple(r) for r in df.collect()] for df in asked[0])
    assert {p[1] for p in prints} == {fingerprint(t) for t in texts}
    assert parts(prints, pairs) == parts(prints, [(a, b) for a, x in prints for b, y in prints if ((x ^ y) & (2**64 - 1)).bit_count() <= 4])
    assert pairs


def parts(prints, pairs):
    """The component's least key of each key."""
    root = {k: k for k, _ in prints}
    for _ in prints:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root
