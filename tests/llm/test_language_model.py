"""Context mixing: base scores by brute force, a proper distribution, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import context_mixing as M


def plain(rows):
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), M.END]

    counts, out = Counter(), []
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [100_000, 20])
def test_base_scores(everything, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    got = M.scored(everything).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=str) == plain([(r.doc_id, r.text) for r in everything.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_head_and_join_agree(documents, monkeypatch):
    scores = []
    for head in (100_000, 5):
        monkeypatch.setattr(M, "HEAD", head)
        scores.append({r.doc_id: r.score for r in M.scored(documents).collect()})
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 * abs(scores[0][i]) for i in scores[0])


def trained(words):
    counts = np.zeros((int(M.OFFSETS[-1]), 2), np.float32)
    M.count_bits(counts, words, np.zeros(len(words), np.int64), np.ones(len(words)))
    return counts


def test_bytes_share_one():
    """The probabilities of all next bytes after a prefix sum to one."""
    model = M.Model(trained([b"the", b"then", b"thing"] * 50), M.Mixer())
    bits = M.Bits([b"th"], np.array([0]))
    total = 0.0
    for byte in range(256):
        bits.bytes = bits.bytes.copy()
        bits.bytes[2] = byte
        logs = 0.0
        for slots, bit, _ in bits.steps():
            x = np.stack([model.predictions[s] for s in slots], 1).astype(np.float32)
            gate = model.mixer.gate(bits, model.sure[slots[4] - M.OFFSETS[4]].astype(np.int64))
            p = model.mixer.refined(model.mixer.mixed(x, gate), gate)[2]
            logs += math.log(p if bit[2] else 1 - p)
        total += math.exp(logs)
    assert total == pytest.approx(1, abs=1e-5)


def test_prefix_hash_is_of_the_prefix():
    """Contexts depend on the word alone, not on what stands before it in a batch."""
    words = [b"alpha", b"beta", M.END.encode(), b"alpha", "käse".encode()]
    for contexts in zip(*[[c[M.Bits(words, np.zeros(5)).word == i] for i in (0, 3)] for c in M.Bits(words, np.zeros(5)).contexts], strict=True):
        assert all(len(c) == 6 for c in contexts)
    bits = M.Bits(words, np.zeros(5))
    assert all((c[bits.word == 0] == c[bits.word == 3]).all() for c in bits.contexts)


def test_held_out_gain(spark):
    """Held-out texts take far fewer bits per byte than by the frequencies of bytes alone."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.scored(df).filter("held_out").collect()
    texts = [r.text.encode().lower() for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    counts = Counter(b"".join(texts))
    size = sum(counts.values())
    alone = -sum(n / size * math.log2(n / size) for n in counts.values())
    bits_per_byte = -sum(r.score for r in rows) / math.log10(2) / size
    assert bits_per_byte < min(2.5, 0.65 * alone)


def test_no_training_rows(spark, nothing):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = M.scored(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].base_score) == (0, 0, 0.0)
    assert rows[0].score == pytest.approx(-(3 + 1) * 8 * math.log10(2), rel=1e-6)
    assert M.scored(nothing).count() == 0


def test_mixer_learns_from_all_words(spark):
    """Every training word teaches the mixer, long ones too, and how words lie in partitions changes nothing."""
    words = [f"{'averylongword' * 4}{i}" for i in range(70)]
    n = [i % 5 + 1 for i in range(70)]
    vocabulary = spark.createDataFrame([(w, [k] + [0] * (M.CLASSES - 1)) for w, k in zip(words, n, strict=True)], "word string, trained array<long>")
    counts = np.zeros((int(M.OFFSETS[-1]), 2), np.float32)
    M.count_bits(counts, [w.encode() for w in words], np.zeros(70, np.int64), np.array(n))
    mixers = [M.fitted(v, counts, 2) for v in (vocabulary.coalesce(1), vocabulary.repartition(5), vocabulary.filter("word not like '%7'"))]
    assert not np.array_equal(mixers[0].weights, M.Mixer().weights)
    assert np.array_equal(mixers[0].weights, mixers[1].weights) and np.array_equal(mixers[0].map, mixers[1].map)
    assert not np.array_equal(mixers[0].map, mixers[2].map)


def test_shared_beginnings_are_coded_once(monkeypatch):
    """Words that begin alike share their first bytes, with the scores and counts of words coded alone."""
    words, classes = [b"abcdef", b"abcdeg", b"abcdef", b"xyz", b"abc"], np.array([0, 0, 1, 0, 0])
    together, alone = np.zeros((int(M.OFFSETS[-1]), 2), np.float32), np.zeros((int(M.OFFSETS[-1]), 2), np.float32)
    M.count_bits(together, words, classes, np.array([3, 1, 2, 5, 1]))
    for i, n in enumerate([3, 1, 2, 5, 1]):
        M.count_bits(alone, words[i:i + 1], classes[i:i + 1], np.array([n]))
    assert (together == alone).all() and together.sum() > 0
    model = M.Model(together, M.Mixer())
    coded, mixed = [], M.Mixer.mixed
    monkeypatch.setattr(M.Mixer, "mixed", lambda self, x, gate: coded.append(len(x)) or mixed(self, x, gate))
    scores = model.scores(words, classes)
    assert coded == [7 + 2 + 7 + 4 + 1] * 8
    assert scores.tolist() == [float(model.scores(words[i:i + 1], classes[i:i + 1])[0]) for i in range(len(words))]


def test_pairs(monkeypatch):
    """Words and the classes before them are counted apart for texts held out, whatever waits or is passed on."""
    texts = [["one", "two.", "one", "$x"], [], ["two.", "two.", "é", "one"], ["one"] * 9]
    plain = {True: Counter(), False: Counter()}
    for i, words in enumerate(texts):
        before = 1
        for w in [*words, M.END]:
            plain[i % 2 == 1][w, before] += 1
            before = M.word_class(w.encode())
    for limit in (1 << 19, 2):
        monkeypatch.setattr(M, "BATCH", limit)
        pairs = M.Pairs()
        for _ in range(2):  # the second time after all was forgotten
            for i, words in enumerate(texts):
                pairs.add([w.encode() for w in words], i % 2 == 1)
            got = {True: Counter(), False: Counter()}
            for rows in pairs.passed():
                for r in rows.itertuples():
                    got[r.held_out][r.word, r.cls] += r.n
            assert got == plain


def test_tokens_of_many_texts():
    """Texts cut together give the words, classes and ends of each text by itself, however they are sliced."""
    import pyarrow as pa
    texts = ["", " ", " a  b ", "\x0bÀÉ İ a b\x1cx\x85y", "A\tB\nC\rD\x0cE\x0b", " x y　z! $q", "\x00 \x1f q.", "é, !a", "one two. one"]
    words, number, before, owner = M.tokens(pa.array(texts))
    spelled, got = words.to_pylist(), [[] for _ in texts]
    for n, b, o in zip(number, before, owner, strict=True):
        got[o].append((spelled[n], b))
    for text, pairs in zip(texts, got, strict=True):
        last, plain_pairs = 1, []
        for w in [*[w.decode() for w in text.encode().lower().split()], M.END]:
            plain_pairs.append((w, last))
            last = M.word_class(w.encode())
        assert pairs == plain_pairs
    batch = pa.record_batch({"text": pa.array(texts), "held_out": pa.array([i % 2 > 0 for i in range(len(texts))])})
    counts = Counter()
    for row in M.pairs_of(batch).to_pylist():
        counts.update({(row["word"], c): row[c] for c in M.COUNTS if row[c]})
    assert counts == Counter((w, f"{'held' if i % 2 else 'trained'}_{b}") for i, pairs in enumerate(got) for w, b in pairs)


def test_teaching_shares_beginnings():
    """A batch with words and classes that come twice teaches what the same batch with added counts teaches."""
    words, classes, n = [b"then", b"the", b"then", b"thing", b"the"], np.array([0, 1, 0, 0, 1]), np.array([2, 1, 3, 4, 5])
    predictions, got = M.Predictions(trained(words)), []
    for rows in ((words, classes, n), (words[1:4], classes[1:4], np.array([6, 5, 4]))):
        mixer = M.Mixer()
        got.append((*predictions.teach(mixer, *rows), mixer.weights))
    for a, b in zip(*got, strict=True):
        assert np.allclose(a, b)
