"""Best-fit packing by minimum bin slack.

Each bin takes the longest piece left and, by subset sums on a bitset over the lengths still
available, the combination that fills the rest best; it is then removed. Bins depend on
lengths alone, and there are no more lengths than tokens in a sequence, so they are planned
on the histogram of lengths: a combination is taken as often as its lengths last, which is
what repeated searches would find. Pieces find their bin by their rank among pieces of the
same length; ranks come from counts per salted bucket, so no task sees a whole length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, per_row, texts

CACHE = 400_000  # distinct words a worker remembers; then it forgets all and goes on
BUCKET = 1000  # pieces of one length in a bucket
TAIL = b".,!?*#$%&|;:"  # marks that the pattern always splits from the letters before them


LETTERS = re.compile("[a-zß-öø-ÿ]+")  # lower case, composed, one pre-token whatever the language


class WordIds(dict):
    """Ids of white-space separated words, packed as little-endian unsigned 32 bits.

    The tokenizer drops white space and never merges across it, so the ids of a text are those
    of its words one after another, and repeated words are encoded once. Plain words go to the
    tokenizer's model as they are, other ones through all of its steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, level = self.tok.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # bytes beyond ASCII as the model spells them

    def plain(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.translate(self.spelling)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        core = word.rstrip(TAIL)
        text, tail = core.decode(), word[len(core):]
        if LETTERS.fullmatch(text):
            found = self.plain(text) + (self[tail] if tail else b"")
        else:
            found = array("I", self.tok.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        words = (raw if b"<|" in raw else raw.lower()).split()  # special strings are matched as they are written
        return b"".join(map(self.__getitem__, words))


@cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, which serves many tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each document and its end, cut at `capacity`."""
    def make():
        ids = word_ids(tokenizer_path)
        end = end_id.to_bytes(4, "little")

        def work(rows):
            out = []
            for row in rows:
                packed = ids.ids(row["text"]) + end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at:at + 4 * capacity]
                    out.append({"doc_id": row["doc_id"], "piece": piece, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
            return out
        return work

    return per_row(texts(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within `room`: length -> how many."""
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            left -= take
            take *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, combination) until nothing is left."""
    counts, out = dict(counts), []
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            chosen = fullest(counts, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(counts[n] // k for n, k in chosen.items())
            for n, k in chosen.items():
                counts[n] -= times * k
            out.append((times, chosen))
    return out


def slots(counts: dict[int, int], capacity: int) -> list[dict]:
    """Per length: which ranks go to which sequences and where in them."""
    used, by_length, sequence = dict.fromkeys(counts, 0), {n: [] for n in counts}, 0
    for times, chosen in plan(counts, capacity):
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            by_length[n].append({"first": used[n], "past": used[n] + times * k, "each": k, "sequence": sequence, "offset": offset})
            used[n] += times * k
            offset += n * k
        sequence += times
    return [{"length": n, "slots": found} for n, found in by_length.items()]


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Every row is placed, repeated rows and null ids too; without rows nothing is packed.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    schema = "length long, slots array<struct<first: long, past: long, each: long, sequence: long, offset: long>>"
    places = spark.createDataFrame(slots(counts, capacity), schema)
    salts = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts.items()], "length long, _salts long")
    salted = (parts.join(F.broadcast(salts), "length")  # at most `capacity` rows
              .withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), "_salts")).drop("_salts"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (salted.groupBy("length", "_bucket").count()
              .select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    rank = F.col("_before") + F.row_number().over(inside) - 1
    s, within = F.col("_slot"), F.col("_rank") - F.col("_slot.first")
    return (
        salted.join(starts, ["length", "_bucket"]).withColumn("_rank", rank)
        .join(F.broadcast(places), "length")  # at most `capacity` rows
        .withColumn("_slot", F.expr("filter(slots, s -> s.first <= _rank AND _rank < s.past)[0]"))
        .select(*parts.columns,
                (s["sequence"] + F.floor(within / s["each"])).alias("sequence_id"),
                (s["offset"] + within % s["each"] * F.col("length")).alias("offset"))
    )


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of `docs`.

    A null or empty text is one piece that holds the end alone; other columns are ignored.
    """
    return pack(cut(pieces(docs, tokenizer_path, capacity)), capacity)
