"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for base secrets and for further candidates (known token formats and
long mixed strings). Values are hashed and counted by distinct owners and repositories over
the corpus: a value that many owners share, or many documents of one, is a copied example; one
that stays in a few documents of an owner or two looks live. Live candidates are added to the base spans, which always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, parted, per_row

KINDS = ("assign", "access", "hex", "token")  # in the order of equal starts; the last is the method's
# Patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one fails as a whole
WORDS = ("passw", "secret", "token", "api")  # one of them stands in every keyword
# Public token formats, and long strings that may be keys.
FORMATS = re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
SPAN = "struct<kind: int, start: int, end: int, hash: long>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), leftmost non-overlapping per kind."""
    found = []
    folded = text.lower()
    if any(word in folded for word in WORDS) and (":" in text or "=" in text):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further values, none of which touches a base span or one before it."""
    found = [(3, m.start(), m.end(), m[0]) for m in FORMATS.finditer(text)]
    for m in MIXED.finditer(text):
        value = m[0]
        kinds = (any(c.isdigit() for c in value), any(c.isupper() for c in value), any(c.islower() for c in value))
        if all(kinds) and entropy(value) >= 3.5:
            found.append((3, m.start(), m.end(), value))
    taken, out = [(s[1], s[2]) for s in base], []
    for span in sorted(found, key=lambda s: (s[1], -s[2])):
        if all(span[2] <= a or b <= span[1] for a, b in taken):
            out.append(span)
            taken.append((span[1], span[2]))
    return out


def scanned(docs: DataFrame, owner: str = "source") -> DataFrame:
    """row (unique), doc_id, text_hash, owner, base and extra spans of each row of `docs`."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"),
                       F.col(owner).cast("string").alias("owner"))

    def make():
        from pyspark import TaskContext
        state = {"next": TaskContext.get().partitionId() << 40}

        def work(batch):
            out = []
            for r in batch:
                base = base_spans(r["text"])
                spans = [[{"kind": k, "start": a, "end": b, "hash": hashed(v)} for k, a, b, v in some] for some in (base, candidates(r["text"], base))]
                out.append({"row": state["next"], "doc_id": r["doc_id"], "text_hash": r["text_hash"], "owner": r["owner"], "base": spans[0], "extra": spans[1]})
                state["next"] += 1
            return out
        return work

    return per_row(rows, make, f"row long, doc_id long, text_hash long, owner string, base array<{SPAN}>, extra array<{SPAN}>")


def secrets(docs: DataFrame, owner: str = "source", most_owners: int = 2, most_repositories: int = 20) -> DataFrame:
    """doc_id, text_hash, base spans, added (live) spans, n_live and n_copied of each row.

    The owner of a document is its `owner` column (null: the document is its own owner), its
    repository the document itself (without an id: the row). A value held by more than
    `most_owners` owners is a copied example, and so is one in more than `most_repositories`
    documents, within one owner too.
    A null text has no spans; repeated rows give repeated rows; a null doc_id stays null; other
    columns are ignored.
    """
    rows = cut(scanned(docs, owner))
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    own = F.struct("owner", F.when(F.col("owner").isNull(), document).alias("document"))
    values = rows.select("row", document.alias("repository"), own.alias("owner"), F.explode(F.concat("base", "extra")).alias("span"))
    spread_of = (values.groupBy(F.col("span.hash").alias("hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
                 .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
                 .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    verdicts = (values.withColumn("hash", F.col("span.hash")).join(cut(spread_of), "hash")
                .groupBy("row").agg(F.sort_array(F.collect_list(F.when(live & (F.col("span.kind") == len(KINDS) - 1), F.col("span")))).alias("added"),
                                    F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_copied")))
    return rows.join(verdicts, "row", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with all spans of `found` (see `secrets`) overwritten by as many asterisks; texts keep their length.

    Only rows that may have spans are joined; the others stay where they are.
    """
    spans = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.concat("base", "added").alias("_spans"))
             .filter(F.size("_spans") > 0).dropDuplicates(["_id", "_hash"]))
    some, rest = parted(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), spans.select(F.xxhash64("_id", "_hash")))
    same = some["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(some["text"]) == F.col("_hash"))

    def mask(text, s):
        return F.concat(F.substring(text, F.lit(1), s["start"]), F.repeat(F.lit("*"), s["end"] - s["start"]), F.substring(text, s["end"] + 1, F.length(text)))

    text = F.when(F.col("_spans").isNull(), some["text"]).otherwise(F.aggregate("_spans", some["text"], mask))
    return some.join(spans, same, "left").select(*[text.alias(c) if c == "text" else some[c] for c in docs.columns]).union(rest)
