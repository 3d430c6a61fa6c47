"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded word by word, a word byte by byte with a closing space, a byte bit by bit; a
newline where a word could start ends the text. Each bit is predicted by counts under six
hashed contexts (one to four bytes before it, the word so far, and the word so far together
with the class of the previous word). The predictions are mixed in the logistic domain by
weights that a gate picks (place in the word, how well the word so far is known, class of the
previous word), and an adaptive map refines the mixture. The
probabilities of all bits multiply to that of the text.

A word's probability depends on its spelling and on the class of the word before it, so it is
computed once per word and class over the whole corpus, and documents sum over their words.
Counts come from all training documents: words are counted before they are shuffled, and the
hashed counts have a fixed number of slots. Weights and map are learned from all training words
as often as they occur, each occurrence left out of its own counts: every task learns online from
its share of the words, then weights are averaged by what their gates saw and the hits of the map
are added. The most frequent words (HEAD, a bounded table) are summed where the text is read; the
others are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, texts

END = "\n"  # the end of a text, as a word of its own
CLASSES = 8  # of the previous word
COUNTS = [f"{kind}_{c}" for kind in ("trained", "held") for c in range(CLASSES)]  # of a word after each class
SLOTS = (18, 19, 20, 20, 20, 20)  # bits of each context's table
OFFSETS = np.cumsum([0] + [2**b for b in SLOTS])
GATES = 8 * 3 * CLASSES
RATE = 0.08  # of a step along a gate's mean slope
LEAST = 256  # bits a gate's slope is taken over at least
STRIDE = 1 << 14  # bytes between two steps
TRAINERS = 64  # most tasks that hold a table of counts
BLOCK = 1 << 18  # slots of a block of counts
HEAD = 100_000  # words summed where they are read
HEAD_BYTES = 48  # longest of them, in characters
SLICE = 1 << 22  # bytes of text cut into words at a time
BATCH = 1 << 19  # bytes coded at a time
MARKS = frozenset(b".,!?:;")
SYMBOLS = frozenset(b"#*$%&|<>!")


def word_class(word: bytes) -> int:
    """Class of a word as context of the next: how it ends, whether it has symbols, whether it is beyond ASCII."""
    return (word[-1] in MARKS) + 2 * (not SYMBOLS.isdisjoint(word)) + 4 * (not word.isascii())


def word_classes(words: pa.Array) -> np.ndarray:
    """`word_class` of many words, none of them empty."""
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    if not len(size):
        return size
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
    starts = np.cumsum(size) - size
    symbol, beyond = (np.logical_or.reduceat(x, starts) for x in (np.isin(raw, [*SYMBOLS]), raw > 127))
    return np.isin(raw[starts + size - 1], [*MARKS]) + 2 * symbol + 4 * beyond


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about SLICE bytes of text; a longer text is one by itself."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the end first; of every token, a text's end after its words: its number among them, the class before it and its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, row = split.flatten(), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(flat), 0)  # space at an end of a text leaves an empty word
    coded, row = flat.filter(some).dictionary_encode(), row.filter(some).to_numpy().astype(np.int64)
    number = np.zeros(len(row) + len(text), np.int64)
    number[np.arange(len(row)) + row] = coded.indices.to_numpy() + 1
    kind = np.concatenate([[1], word_classes(coded.dictionary)])  # the start of a text counts as the end of a sentence
    before = np.ones(len(number), np.int64)
    before[1:] = kind[number[:-1]]
    words = pa.concat_arrays([pa.array([END], coded.dictionary.type), coded.dictionary])
    return words, number, before, np.repeat(np.arange(len(text)), np.bincount(row, minlength=len(text)) + 1)


class Pairs:
    """How often each word follows each class in texts held out and others."""

    def __init__(self):
        self.waiting: list[tuple[str, bool]] = []

    def add(self, words: list[bytes], out: bool) -> None:
        """All tokens of a text, its end too."""
        self.waiting.append((b" ".join(words).decode(), out))

    def passed(self) -> Iterator[pd.DataFrame]:
        """word, cls, held_out and n of all pairs seen, which are forgotten then."""
        texts, out = zip(*self.waiting, strict=True) if self.waiting else ((), ())
        self.waiting = []
        for part in slices(pa.record_batch({"text": pa.array(texts, pa.string()), "held_out": pa.array(out, pa.bool_())})):
            rows = pairs_of(part).to_pandas().melt("word", COUNTS, value_name="n")
            rows["cls"] = rows["variable"].str[-1:].astype(int)
            yield rows.assign(held_out=rows["variable"].str.startswith("held")).query("n > 0")[["word", "cls", "held_out", "n"]]


def pairs_of(part: pa.RecordBatch) -> pa.RecordBatch:
    """Each distinct word of some texts, and how often it follows each class in training texts and in those held out (COUNTS)."""
    words, number, before, owner = tokens(part["text"])
    held = part["held_out"].to_numpy(zero_copy_only=False)[owner].astype(np.int64)
    counts = np.bincount((held * CLASSES + before) * len(words) + number, minlength=len(COUNTS) * len(words)).reshape(len(COUNTS), -1)
    return pa.RecordBatch.from_arrays([words, *map(pa.array, counts)], ["word", *COUNTS])


class Bits:
    """The bits of many words: for each of the eight bits of every byte, slots, gate parts and values.

    `word` gives the word of each byte, so sums over bytes give words. Words that begin alike
    share their first bytes, which `distinct` keeps once: the more so the closer they are sorted.
    """

    def __init__(self, words: list[bytes], classes: np.ndarray):
        spelled = [w if w == END.encode() else w + b" " for w in words]
        size = np.array([len(w) for w in spelled], np.int64)
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), size)
        starts = np.repeat(np.cumsum(size) - size, size)
        self.place = np.arange(len(self.bytes)) - starts
        self.classes = np.asarray(classes, np.int64)[self.word]
        last = []
        for k in range(1, 5):
            byte = np.zeros(len(self.bytes), np.uint64)
            byte[k:] = self.bytes[:-k]
            last.append(np.where(self.place >= k, byte + np.uint64(1), np.uint64(0)))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(self.bytes), 0x9E3779B97F4A7C15, np.uint64))  # odd, so it has an inverse
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes + np.uint64(1)) * power)])
            back = np.cumprod(np.full(len(self.bytes), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
            prefix = (total[:-1] - total[starts]) * back[starts]
            one = last[0]
            two = one * np.uint64(257) + last[1]
            three = two * np.uint64(257) + last[2]
            four = three * np.uint64(257) + last[3]
            self.contexts = [c * np.uint64(0xD6E8FEB86659FD93) for c in (
                one, two, three, four, prefix, prefix + (self.classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))]

    def distinct(self) -> np.ndarray:
        """Keep each byte after the same beginning of a word and class once; gives the place of every byte among those kept."""
        with np.errstate(over="ignore"):
            key = (self.contexts[5] + self.bytes + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        self.bytes, self.place, self.classes, self.contexts = self.bytes[first], self.place[first], self.classes[first], [c[first] for c in self.contexts]
        return place

    def steps(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
        """(slots per context, bit, its number in the byte), from the highest bit on."""
        for k in range(8):
            node = np.uint64(1) << np.uint64(k) | self.bytes >> np.uint64(8 - k)
            bit = (self.bytes >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
            with np.errstate(over="ignore"):
                node = node * np.uint64(0xE7037ED1A0B428DB)
                slots = [(((c + node) * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - SLOTS[i])).astype(np.int64) + OFFSETS[i]
                         for i, c in enumerate(self.contexts)]
            yield slots, bit, k


def batches_of(words: list[bytes], limit: int = BATCH) -> Iterator[slice]:
    """Slices of about `limit` bytes; a longer word is one by itself."""
    start = held = 0
    for i, w in enumerate(words):
        if held and held + len(w) + 1 > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(w) + 1
    if held:
        yield slice(start, len(words))


def count_bits(counts: np.ndarray, words: list[bytes], classes: np.ndarray, weight: np.ndarray) -> None:
    """Add weighted bits to counts (slots x 2)."""
    for at in batches_of(words):
        bits = Bits(words[at], classes[at])
        w = np.bincount(bits.distinct(), weight[at][bits.word]).astype(np.float32)
        for slots, bit, _ in bits.steps():
            for s in slots:
                np.add.at(counts.reshape(-1), 2 * s + bit, w)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.where(n0 + n1 > 0, np.log((np.maximum(n1, 0) + 0.3) / (np.maximum(n0, 0) + 0.3)), 0.0).astype(np.float32)


def confidence(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n >= 8)


class Mixer:
    """Gated weights over stretched predictions, and a map that refines the mixture."""

    STEPS = 24  # of the map, over stretched probabilities from -8 to 8

    def __init__(self):
        self.weights = np.full((GATES, len(SLOTS)), 0.3, np.float32)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, self.STEPS + 1))), (8 * 3, 1))

    @staticmethod
    def gate(bits: Bits, sure: np.ndarray) -> np.ndarray:
        return (np.minimum(bits.place, 7) * 3 + sure) * CLASSES + bits.classes

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -8, 8)

    def refined(self, t: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability that the bit is 1: the mean of the mixture and of the map read at it."""
        at = (t + 8) * (self.STEPS / 16)
        low = np.minimum(at.astype(np.int64), self.STEPS - 1)
        part, row = at - low, gate // CLASSES
        mapped = self.map[row, low] * (1 - part) + self.map[row, low + 1] * part
        return np.clip((1 / (1 + np.exp(-t)) + mapped) / 2, 1e-6, 1 - 1e-6)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One online step over bits that occur n times. What each gate saw, and the bits and set bits at each place of the map."""
        t = self.mixed(x, gate)
        near = gate // CLASSES * (self.STEPS + 1) + np.rint((t + 8) * (self.STEPS / 16)).astype(np.int64)
        off, seen = (bit - 1 / (1 + np.exp(-t))) * n, np.bincount(gate, n, GATES)
        slope = np.stack([np.bincount(gate, off * x[:, i], GATES) for i in range(x.shape[1])], 1)
        self.weights += (RATE * slope / np.maximum(seen, LEAST)[:, None]).astype(np.float32)
        return seen, np.stack([np.bincount(near, w, self.map.size).reshape(self.map.shape) for w in (n, n * bit)], 2)

    def mapped(self, hits: np.ndarray, prior: float = 20.0) -> None:
        self.map = (hits[:, :, 1] + prior * self.map) / (hits[:, :, 0] + prior)


class Predictions:
    """Stretched predictions and confidences of all slots (a fixed size), with a bit's own occurrence left out of both."""

    def __init__(self, counts: np.ndarray):
        n0, n1 = counts[:, 0], counts[:, 1]
        self.left_out = np.stack([stretched(n0 - 1, n1), stretched(n0, n1 - 1)], 1).astype(np.float16).reshape(-1)
        self.sure = confidence(counts[OFFSETS[4]:OFFSETS[5]].sum(1) - 1).astype(np.uint8)

    def teach(self, mixer: Mixer, words: list[bytes], classes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bits of words that occur n times after a class, learned in turn; sums of what `learn` gives."""
        seen, hits = np.zeros(GATES), np.zeros((*mixer.map.shape, 2))
        for at in batches_of(words, STRIDE):
            bits = Bits(words[at], classes[at])
            times = np.bincount(bits.distinct(), n[at][bits.word])
            for slots, bit, _ in bits.steps():
                x = np.stack([self.left_out[2 * s + bit] for s in slots], 1).astype(np.float32)
                some = mixer.learn(x, mixer.gate(bits, self.sure[slots[4] - OFFSETS[4]].astype(np.int64)), bit, times)
                seen += some[0]
                hits += some[1]
        return seen, hits


class Model:
    """Stretched predictions and confidences of all slots (a fixed size), with the fitted mixer."""

    def __init__(self, counts: np.ndarray, mixer: Mixer):
        self.mixer = mixer
        self.predictions = stretched(counts[:, 0], counts[:, 1]).astype(np.float16)
        self.sure = confidence(counts[OFFSETS[4]:OFFSETS[5]].sum(1)).astype(np.uint8)

    def scores(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 probability of each word after a word of a class."""
        out = np.zeros(len(words))
        for at in batches_of(words):
            bits = Bits(words[at], classes[at])
            place = bits.distinct()
            total = np.zeros(len(bits.bytes))
            for slots, bit, _ in bits.steps():
                x = np.stack([self.predictions[s] for s in slots], 1).astype(np.float32)
                gate = self.mixer.gate(bits, self.sure[slots[4] - OFFSETS[4]].astype(np.int64))
                p = self.mixer.refined(self.mixer.mixed(x, gate), gate)
                total += np.log10(np.where(bit > 0, p, 1 - p))
            out[at] = np.bincount(bits.word, total[place], minlength=at.stop - at.start)
        return out


def counted(docs: DataFrame) -> DataFrame:
    """word and, in all documents and in training ones, how often it follows each class (arrays of CLASSES)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(pairs_of, slices(batch))

    pairs = docs.select("text", "held_out").mapInArrow(task, ", ".join(["word string", *[f"{c} long" for c in COUNTS]]))
    sums = pairs.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    trained, held = COUNTS[:CLASSES], COUNTS[CLASSES:]
    return sums.select("word", F.array(*[F.col(t) + F.col(h) for t, h in zip(trained, held, strict=True)]).alias("uses"), F.array(*trained).alias("trained"))


def flat(words: pd.Series, uses: pd.Series) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(word, class, row, count) of all counts above zero."""
    table = np.array(uses.tolist(), np.int64).reshape(-1, CLASSES)
    row, cls = np.nonzero(table)
    raw = [w.encode() for w in words]
    return [raw[i] for i in row], cls, row, table[row, cls]


def bit_counts(vocabulary: DataFrame, tasks: int) -> np.ndarray:
    """Counts (slots x 2) of all training words; blocks of a fixed table are summed on the executors."""
    slots = int(OFFSETS[-1])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, some = np.zeros((slots, 2), np.float32), False
        for batch in batches:
            words, cls, _, n = flat(batch["word"], batch["trained"])
            some = some or bool(words)
            count_bits(counts, words, cls, n)
        if some:
            for block, at in enumerate(range(0, slots, BLOCK)):
                yield pd.DataFrame({"block": [block], "data": [zlib.compress(counts[at:at + BLOCK].tobytes(), 1)]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(d), np.float32).astype(np.float64) for d in group["data"])
        return pd.DataFrame({"block": group["block"].iloc[:1], "data": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})

    spread = vocabulary.select("word", "trained").repartition(tasks).sortWithinPartitions("word")
    rows = spread.mapInPandas(task, "block int, data binary").groupBy("block").applyInPandas(added, "block int, data binary").collect()
    out = np.zeros((slots, 2), np.float32)
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["data"]), np.float32).reshape(-1, 2)
        out[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] = part
    return out


def fitted(vocabulary: DataFrame, counts: np.ndarray, tasks: int) -> Mixer:
    """The mixer, learned from all training words as often as they occur, each occurrence left out of its own counts.

    Words are dealt and ordered by their hashes, so the same words give the same mixer.
    """
    predictions = vocabulary.sparkSession.sparkContext.broadcast(Predictions(counts))  # a fixed number of slots

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer = Mixer()
        seen, hits = np.zeros(GATES), np.zeros((*mixer.map.shape, 2))
        for batch in batches:
            words, cls, _, n = flat(batch["word"], batch["trained"])
            some = predictions.value.teach(mixer, words, cls, n)
            seen, hits = seen + some[0], hits + some[1]
        if seen.any():
            yield pd.DataFrame({"part": [0, 1, 2], "data": [x.tobytes() for x in (mixer.weights * seen[:, None], seen, hits)]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[:1], "data": [sum(np.frombuffer(d) for d in sorted(group["data"])).tobytes()]})

    dealt = vocabulary.select("word", "trained").repartition(tasks, "word").sortWithinPartitions(F.xxhash64("word"), "word")
    rows = dealt.mapInPandas(task, "part int, data binary").groupBy("part").applyInPandas(added, "part int, data binary").collect()
    predictions.destroy()
    mixer = Mixer()
    if rows:
        weights, seen, hits = (np.frombuffer(r["data"]) for r in sorted(rows, key=lambda r: r["part"]))
        mixer.weights = np.where(seen[:, None] > 0, weights.reshape(GATES, -1) / np.maximum(seen, 1)[:, None], mixer.weights).astype(np.float32)
        mixer.mapped(hits.reshape(*mixer.map.shape, 2))
    return mixer


def scored(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`.

    Held out are rows whose CRC-32 of doc_id as text leaves `held` by `folds`; a row without id
    trains. A null or empty text is its end alone; repeated rows count and score as often as
    they stand there; without training rows the counts are zero and every bit has even odds;
    other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    split = texts(docs).withColumn("held_out", held_out)
    vocabulary = cut(counted(split))
    trained = F.aggregate("trained", F.lit(0).cast("long"), lambda a, x: a + x)
    size = vocabulary.agg(F.sum(trained).alias("n"), F.sum((trained > 0).cast("long")).alias("v"), F.count(F.lit(1)).alias("rows")).first()
    total, distinct = size["n"] or 0, size["v"] or 0
    tasks = max(1, min(TRAINERS, size["rows"] // 50_000))
    counts = bit_counts(vocabulary, tasks)
    model = spark.sparkContext.broadcast(Model(counts, fitted(vocabulary, counts, tasks)))  # a fixed number of slots
    del counts

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, cls, row, _ = flat(batch["word"], batch["uses"])
            table = np.zeros((len(batch), CLASSES))
            table[row, cls] = model.value.scores(words, cls)
            known = np.array(batch["trained"].tolist(), np.int64).reshape(-1, CLASSES).sum(1)
            n = np.array(batch["uses"].tolist(), np.int64).reshape(-1, CLASSES).sum(1)
            yield pd.DataFrame({"word": batch["word"], "n": n, "known": known, "logs": list(table)})

    spelled = cut(vocabulary.sortWithinPartitions("word").mapInPandas(spell, "word string, n long, known long, logs array<double>"))
    top = spelled.filter(F.length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD).select("word", "known", "logs").collect()
    under = float(total + distinct + 1)
    head = spark.sparkContext.broadcast((  # at most HEAD short words
        {r["word"]: i for i, r in enumerate(top)}, np.array([r["known"] for r in top], np.int64), np.array([r["logs"] for r in top]).reshape(-1, CLASSES)))
    del top

    schema = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
              "words array<string>, cls array<int>, times array<long>")

    def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        index, known, logs = head.value
        base, first = np.log10((known + 1) / under), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                words, number, before, owner = tokens(part["text"])
                size = part.num_rows
                place = np.fromiter(map(index.get, words.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(words))[number]
                here = place >= 0
                p, mine = place[here], owner[here]
                sums = [np.bincount(mine, x, size) for x in (known[p] > 0, base[p], logs[p, before[here]])]
                rest, times = np.unique((owner[~here] * len(words) + number[~here]) * CLASSES + before[~here], return_counts=True)
                rest, cls = np.divmod(rest, CLASSES)
                whose, which = np.divmod(rest, len(words))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=size))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(which)), pa.array(cls.astype(np.int32)), pa.array(times))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + np.arange(size)), part["doc_id"], part["held_out"], pa.array(np.bincount(owner, minlength=size)),
                     *[pa.array(x.astype(t)) for x, t in zip(sums, (np.int64, float, float), strict=True)], *lists], names)
                first += size

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "cls", "times"]
    read = cut(split.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(read_task, schema))
    rest = read.select("row", F.explode(F.arrays_zip("words", "cls", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.cls", "x.times")
    sums = (rest.join(spelled.select("word", "known", "logs"), "word")
            .groupBy("row").agg(F.sum(F.when(F.col("known") > 0, F.col("times")).otherwise(0)).alias("known"),
                                F.sum(F.col("times") * F.log10((F.col("known") + 1) / under)).alias("more_base"),
                                F.sum(F.col("times") * F.get("logs", "cls")).alias("more_score")))
    return read.drop("words", "cls", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
