"""Token counts of whole texts; huge ones by overlapping chunks that are resynchronised.

A text beyond `chunk` characters is encoded in chunks that overlap. Both chunks of a joint
give token ends with offsets; the joint is spliced at the first place in the overlap where
both end a token and where the split of the pattern is proven: a place no pre-token can
cross, whatever stands around it. Where the overlap has no such place it is widened
fourfold until it has one or reaches the end of the text. Memory follows the chunk (or the
stretch without a proven place), not the text.

A shorter text is cut before spaces where no pre-token can cross either. Counts of pieces that
come again are kept, most pieces are among them; the others are encoded in a row.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame

from barloom.llm.common import per_row, texts

# Places that no alternative of the byte-level pattern and no special token can
# cross. A pre-token holds white space only in front, letters and digits never meet in one,
# and letters are never followed by these marks.
PROVEN = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9.,;:!?])|(?<=[0-9])(?=[A-Za-z])")
# The same for a space after any visible ASCII character: white space stands only in front of a pre-token.
PIECE = re.compile(r"(?<=[!-~])(?= )")
KNOWN = 200_000  # counts of pieces a task keeps, forgotten when there are more
SHORT = 48  # longest piece kept, in characters


class Known(dict):
    """Token counts of pieces met twice or more. `count` gives those of a list of strings."""

    def __init__(self, count):
        self.count, self.met = count, set()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: the sum over its known pieces, and what the other ones count in a row."""
        if len(self) > KNOWN:
            self.clear()
        totals, rests, again = [], [], set()
        for text in texts:
            pieces = PIECE.split(text)
            found = list(map(self.get, pieces))
            rest = [p for p, n in zip(pieces, found, strict=True) if n is None]
            totals.append(sum(filter(None, found)))
            rests.append("".join(rest))
            again.update(p for p in rest if p in self.met and len(p) <= SHORT)
            self.met.update(rest)
        again = list(again)
        counts = self.count(rests + again)
        self.update(zip(again, counts[len(rests):], strict=True))
        self.met.difference_update(again)
        if len(self.met) > KNOWN:
            self.met.clear()
        return [a + b for a, b in zip(totals, counts, strict=False)]


def splice(left: list[tuple[int, int]], right: list[tuple[int, int]], places: list[int], shift: int) -> tuple[int, int] | None:
    """Tokens of each chunk up to the first proven place that ends a token in both.

    `places` counts from the start of the left chunk, `shift` is the right one's start there.
    """
    def ends(offsets):
        return {end: i + 1 for i, (start, end) in enumerate(offsets) if start < end}

    a, b = ends(left), ends(right)
    for p in places:
        if p in a and p - shift in b:
            return a[p], b[p - shift]
    return None


def chunked_count(encode, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """(tokens, widenings) of a text. `encode` gives the offsets of a string's tokens."""
    total, start, skipped, widened = 0, 0, 0, 0
    end = min(len(text), start + chunk)
    left = encode(text[start:end + overlap])
    while end + overlap < len(text):
        wide, found = overlap, None
        right_end = min(len(text), end + chunk)
        right = encode(text[end:right_end + overlap])
        while True:
            # Both sides must reach past the overlap by a character, so that its places are seen with what follows.
            places = [start_of.start() - start for start_of in PROVEN.finditer(text, end + 1, min(len(text), end + wide))]
            found = splice(left, right, places, end - start)
            if found or end + wide >= len(text):
                break
            wide *= 4
            widened += 1
            left = encode(text[start:end + wide])
            if end + wide > right_end + overlap:
                right_end = min(len(text), end + wide)
                right = encode(text[end:right_end + overlap])
        if not found:  # the left chunk has grown to the end of the text
            return total + len(left) - skipped, widened
        total += found[0] - skipped
        start, end, left, skipped = end, right_end, right, found[1]
    return total + len(left) - skipped, widened


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_widened of each row.

    Special strings in a text are handled as the library does by default; none are added.
    A null text counts as empty (0 tokens); repeated rows give repeated rows, a null doc_id
    stays null, other columns are ignored.
    """
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_path)
        tok.no_truncation()
        tok.no_padding()

        known = Known(lambda pieces: [len(e) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)])

        def offsets(s):
            return tok.encode(s, add_special_tokens=False).offsets

        def work(rows):
            counts = iter(known.counts([r["text"] for r in rows if len(r["text"]) <= chunk]))
            out = []
            for row in rows:
                text = row["text"]
                n, widened = (next(counts), 0) if len(text) <= chunk else chunked_count(offsets, text, chunk, overlap)
                out.append({"doc_id": row["doc_id"], "n_bytes": len(text.encode()), "n_tokens": n, "over_limit": n > limit, "n_widened": widened})
            return out
        return work

    return per_row(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_widened long", rows=64)
