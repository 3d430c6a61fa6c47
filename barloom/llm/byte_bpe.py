"""Byte-level BPE by a rank queue over a hierarchical bitmap, and decoding.

Every merge rank has a bucket of positions of the token list. A bitmap of two levels marks
the buckets that hold something; find-first-set on it gives the lowest rank, and the bucket
its leftmost position. Entries whose pair has changed meanwhile are stale and skipped. A
merge costs a constant number of steps, so a pre-token of a million bytes takes no longer
per byte than a short one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from barloom.llm.common import per_row, texts

SHIFT = 6  # a word of the lower level has 64 bits
MASK = (1 << SHIFT) - 1
SHORT = 64  # characters of the longest pre-token that is remembered
CACHE = 250_000  # distinct short pre-tokens a worker remembers, and as many older ones


class ByteBpe:
    """Encodes and decodes by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.values = {rank: token for token, rank in ranks.items()}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))})

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of, n = self.ranks.get, len(piece)
        if (whole := rank_of(piece)) is not None:
            return [whole]
        after, before, paired = list(range(1, n + 1)), list(range(-1, n)), [None] * n
        buckets: dict[int, list[int]] = {}  # heaps of positions
        words: dict[int, int] = {}  # lower level of the bitmap: ranks that have a bucket
        top = 0  # upper level: words that are not zero
        for i in range(n - 1):
            rank = paired[i] = rank_of(piece[i:i + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> SHIFT
                    words[word] = words.get(word, 0) | 1 << (rank & MASK)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << SHIFT) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            if paired[i] != rank:  # stale: one of the two has been merged since
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            paired[gone] = paired[i] = None
            if end < n:
                before[end] = i
                rank = paired[i] = rank_of(piece[i:after[end]])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> SHIFT
                        words[word] = words.get(word, 0) | 1 << (rank & MASK)
                        top |= 1 << word
            if i:
                i = before[i]
                rank = paired[i] = rank_of(piece[i:end])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> SHIFT
                        words[word] = words.get(word, 0) | 1 << (rank & MASK)
                        top |= 1 << word
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.values.__getitem__, ids))


class TextCodec:
    """Whole texts: pre-tokens by a pattern, each encoded by itself, repeated ones once."""

    def __init__(self, bpe: ByteBpe, pattern: str):
        import regex
        self.bpe, self.split = bpe, regex.compile(pattern).findall
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def learn(self, piece: str) -> tuple[int, str, bytes]:
        found = self.old.get(piece)
        if found is None:
            ids = self.bpe.encode(piece.encode())
            found = len(ids), ",".join(map(str, ids)), self.bpe.decode(ids)
        if len(piece) <= SHORT:
            if len(self.young) >= CACHE:
                self.old = dict(self.young)
                self.young.clear()
            self.young[piece] = found
        return found

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids as decimal text, decoded bytes) of each pre-token."""
        known, learn = self.young.get, self.learn
        return [known(piece) or learn(piece) for piece in self.split(text)]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.bpe.encode(piece.encode())]


@cache
def codec_of(ranks_path: str, pattern: str) -> TextCodec:
    """One per Python worker, which serves many tasks."""
    return TextCodec(ByteBpe.load(ranks_path), pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes.

    Every row gives one row, repeated rows too; a null text counts as empty (no ids), a null
    doc_id stays null, other columns are ignored. Texts are encoded whole, whatever their length.
    """
    def make():
        codec = codec_of(ranks_path, pattern)

        def work(rows):
            out = []
            for row in rows:
                ids, decoded, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
                parts = codec.pieces(row["text"])
                for at in range(0, len(parts), 4096):
                    some = parts[at:at + 4096]
                    sizes, listed, spelled = zip(*some, strict=True)
                    n += sum(sizes)
                    ids.update(("" if first else ",").encode() + ",".join(listed).encode())
                    decoded.update(b"".join(spelled))
                    first = False
                out.append({"doc_id": row["doc_id"], "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": decoded.hexdigest()})
            return out
        return work

    return per_row(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
