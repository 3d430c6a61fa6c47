"""Personal data by weak supervision, in DataFrame operations only.

Base patterns find spans that always count. Looser patterns give further candidates. Four
labelers vote on every candidate, base ones too: its shape, a check of its digits or parts, a
gazetteer and words of the context. Expectation-maximisation over the table of vote patterns
estimates how reliable each labeler is per kind and how likely each candidate is real; these
soft labels train the final classifier over features of the span (naive Bayes), which decides
on the candidates that are not base spans. Tables of votes and features have as many rows as
there are combinations, whatever the input; the driver sees nothing but their sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and look-behinds change no match; they keep
# runs without a match from being tried again at each of their characters.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9]){12,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", "", "+")  # a base match holds this string
# Looser shapes: obfuscated addresses, eight groups of hex digits, grouped digits, national numbers.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
)
LOOSE_NEEDS = ("at", ":", "", "")
# Gazetteers: endings of mail domains, networks that name no person, first digits of issuers, country codes.
GAZETTEER = (r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)\z", r"\A(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|23|24|25)",
             r"\A[3-6]", r"\A(?:\+(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])|[(]?[2-9])")
CONTEXT = (r"(?i)\b(?:e-?mail|mail|write|contact|correo|courriel)\b", r"(?i)\b(?:ip|address|host|server|adresse|login)\b",
           r"(?i)\b(?:card|visa|master|credit|karte|carte|tarjeta)\b", r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|m[oó]vil)\b")
VOTES = ("shape", "check", "gazetteer", "context")  # votes: 1 yes, 2 no, 0 abstains
FEATURES = ("check", "length", "marks", "before")
SURE = 0.9  # probability from which on a candidate becomes a span
ROUNDS = 15
CHUNK = 512


def located(text: Column, pattern: str, needs: str) -> Column:
    """Matches as array<struct<start, end, value, before>>: leftmost, non-overlapping, in code points.

    Starts are running sums over the pieces between matches, in chunks, so that a text with
    very many matches costs little more per match.
    """
    none = F.array().cast("array<string>")
    values = F.when(text.contains(needs) if needs else F.lit(True), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    n = F.size(values)
    steps = F.zip_with(F.slice(F.split(text, pattern), 1, n), values, lambda gap, value: F.struct(
        F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("value"), F.right(gap, F.lit(40)).alias("before")))
    empty = "array<struct<start:int,end:int,value:string,before:string>>"

    def walk(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("spans"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
                         lambda c: F.aggregate(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)), zero, walk))

    def join(acc, chunk):
        moved = F.transform(chunk["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"),
                                                               s["value"].alias("value"), s["before"].alias("before")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    zeros = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{empty}>").alias("spans"))
    return F.when(n > 0, F.flatten(F.aggregate(chunks, zeros, join)["spans"])).otherwise(F.array().cast(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: int, value: Column) -> Column:
    """The check of a base match."""
    if kind == 1:
        return F.forall(F.split(value, "[.]"), lambda x: x.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z"))
    n = F.length(digits(value))
    if kind == 2:
        return n.between(13, 19) & F.call_function("luhn_check", digits(value))
    return n.between(9, 15) if kind == 3 else F.lit(True)


def candidate(kind: int, shaped: bool):
    """Maps a located match to its votes and features."""
    def vote(yes):
        return F.when(yes, F.lit(1)).otherwise(F.lit(2))

    def make(x):
        value = x["value"]
        sound = valid(kind, value)
        if not shaped and kind in (0, 1):
            sound = F.lit(True)
        elif not shaped and kind == 3:
            sound = F.length(digits(value)) == 10
        last = F.right(x["before"], F.lit(1))
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (sound & F.lit(shaped)).alias("base"),
            F.lit(1 if shaped else 0).alias("shape"), vote(sound).alias("check"), vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
            F.when(x["before"].rlike(CONTEXT[kind]), 1).otherwise(0).alias("context"),
            F.least(F.floor(F.length(value) / 4).cast("int"), F.lit(8)).alias("length"),
            F.when(value.rlike(r"[\x20(]"), 2).when(value.contains("-"), 1).otherwise(0).alias("marks"),
            F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"\p{L}|\p{N}"), 2).otherwise(3).alias("before"))
    return make


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (kind, start, end) and all candidates of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    groups = [F.transform(located(text, BASE[k], NEEDS[k]), candidate(k, True)) for k in range(4)]
    loose = [F.transform(located(text, LOOSE[k], LOOSE_NEEDS[k]), candidate(k, False)) for k in range(4)]
    rows = docs.select("doc_id", F.concat(*groups).alias("shaped"), F.concat(*loose).alias("loose"))
    base = F.transform(F.filter("shaped", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    rows = rows.select("doc_id", "shaped", "loose", base.alias("base"))

    def apart(c):
        return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return rows.select("doc_id", "base", F.concat("shaped", F.filter("loose", apart)).alias("candidates"))


def log_odds(table: dict[str, float], kind: Column, parts: dict[str, Column]) -> Column:
    """Sum of the table's entries `kind` and `kind:part:value`; what the table lacks counts nothing."""
    entries = F.create_map(*[F.lit(x) for pair in (table or {"": 0.0}).items() for x in pair])
    total = F.coalesce(entries[kind.cast("string")], F.lit(0.0))
    for name, value in parts.items():
        total = total + F.coalesce(entries[F.concat_ws(":", kind, F.lit(name), value)], F.lit(0.0))
    return total


def ratios(weighed: DataFrame, names: tuple[str, ...]) -> dict[str, float]:
    """Log odds per kind and per value of each name, from rows with n and p (probability of being real)."""
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in names]))
    rows = (weighed.select("kind", parts.alias("x"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
            .groupBy("kind", "x.name", "x.value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect())
    totals: dict[tuple[int, str], list[float]] = {}
    for r in rows:
        t = totals.setdefault((r["kind"], r["name"]), [0.0, 0.0, 0])
        t[0], t[1], t[2] = t[0] + r["yes"], t[1] + r["no"], t[2] + 1
    out = {f"{r['kind']}:{r['name']}:{r['value']}": math.log((r["yes"] + 1) / (totals[r["kind"], r["name"]][0] + 3) * (totals[r["kind"], r["name"]][1] + 3) / (r["no"] + 1))
           for r in sorted(rows, key=str)}
    for kind, name in sorted(totals):
        if name == names[0]:
            yes, no, _ = totals[kind, name]
            out[str(kind)] = math.log((yes + 1) / (no + 1))
    return out


def reliabilities(patterns: DataFrame) -> dict[str, float]:
    """Expectation-maximisation over vote patterns (kind, VOTES, n), started from the plain majority."""
    table = {f"{k}:{name}:{v}": w for k in range(4) for name in VOTES for v, w in ((1, 1.0), (2, -1.0))}
    for _ in range(ROUNDS):
        odds = log_odds(table, F.col("kind"), {v: F.col(v) for v in VOTES})
        new = ratios(patterns.withColumn("p", 1 / (1 + F.exp(-odds))), VOTES)
        done = new.keys() == table.keys() and max((abs(new[k] - table[k]) for k in new), default=0.0) < 1e-3
        table = new
        if done:
            break
    return table


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: spans as arrays of (kind, start, end), a row per row of `docs`.

    A null text has no spans; repeated rows give repeated rows; a null doc_id stays null;
    other columns are ignored; without candidates nothing is added.
    """
    rows = cut(found(docs))
    names = list(dict.fromkeys(("kind", *VOTES, *FEATURES)))
    patterns = cut(rows.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n")))
    votes = reliabilities(patterns.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")))
    odds = log_odds(votes, F.col("kind"), {v: F.col(v) for v in VOTES})
    classifier = ratios(patterns.withColumn("p", 1 / (1 + F.exp(-odds))), FEATURES)
    least = math.log(SURE / (1 - SURE))
    real = F.filter("candidates", lambda c: ~c["base"] & (c["check"] == 1) & (log_odds(classifier, c["kind"], {f: c[f] for f in FEATURES}) >= least))
    added = F.transform(real, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
