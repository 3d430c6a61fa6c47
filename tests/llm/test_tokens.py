"""Token operators against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bin_packing, byte_bpe, token_counts

COUNTS, PACKS, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def bag(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (500, 16), (64, 4)])
def test_counts(everything, chunk, overlap):
    tok = Tokenizer.from_file(COUNTS)
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in everything.collect()]
    got = token_counts.token_counts(everything, COUNTS, chunk=chunk, overlap=overlap).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert bag(got) == bag(expected)


def test_overlaps_widen(odd):
    got = {r.doc_id: r.n_widened for r in token_counts.token_counts(odd, COUNTS).collect()}
    assert got[10] > 0  # one pre-token of 70,000 letters has no place to splice
    assert got[9] == 0


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(everything):
    lib = reference()
    expected = []
    for r in everything.collect():
        ids = lib.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert bag(byte_bpe.round_trip(everything, RANKS, P.PATTERN).collect()) == bag(expected)


def test_long_pretokens():
    lib, bpe, rng = reference(), byte_bpe.ByteBpe.load(RANKS), random.Random(1)
    for alphabet in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "äöж"):
        text = "".join(rng.choice(alphabet) for _ in range(20_000))
        ids = bpe.encode(text.encode())
        assert ids == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def packs(rows):
    """Checks that sequences are gapless and within capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing(everything):
    tok = Tokenizer.from_file(PACKS)
    expected = []
    for r in everything.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            expected.append((r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = bin_packing.packed(everything, PACKS).collect()
    assert bag(r[:5] for r in got) == bag(expected)
    assert packs(got) <= -(-sum(e[3] for e in expected) // 2048) + 1


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(0, 4) for _ in range(6)}
        room = rng.randrange(0, 60)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= room}
        chosen = bin_packing.fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(counts[n] >= k > 0 for n, k in chosen.items())


def test_hot_length(spark, monkeypatch):
    """One length in many buckets: ranks still have no gaps."""
    monkeypatch.setattr(bin_packing, "BUCKET", 50)
    parts = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "IF(id % 3 = 0, 700L, id % 40 + 1) AS length")
    assert packs(bin_packing.pack(parts).collect()) == 167  # two of the 334 long pieces fit into one


def test_empty(nothing):
    assert token_counts.token_counts(nothing, COUNTS).count() == 0
    assert byte_bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
    assert bin_packing.packed(nothing, PACKS).count() == 0


def test_pieces_count_as_whole_texts():
    """Counts of pieces add up to those of the library, and a piece met twice is not encoded a third time."""
    rng = random.Random(8)
    marks = ["a", "Z", "1", " ", "  ", "\n", "\t", "'", "'s", "!", "é", "中", "<|endoftext|>", "\xa0", "\u3000", "\x1c", "\x85", "\u200b", "~", "\U0001f600", "\r\n"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(25))) for _ in range(5000)]
    tok, encoded = Tokenizer.from_file(COUNTS), []

    def count(some):
        encoded.append(sum(map(len, some)))
        return [len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)]

    known = token_counts.Known(count)
    got = [n for at in range(0, 5000, 50) for n in known.counts(texts[at:at + 50])]
    assert got == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    words = token_counts.Known(count)
    assert words.counts(["one two three"]) == words.counts(["one two three"]) == words.counts(["one two three"])
    assert encoded[-1] == 0
