"""Quality rules: measures of whole texts, and cutoffs whose false rejections are bounded.

Cutoffs are certified on labelled documents. Per stratum and measure they are tested from
the mildest to the strictest on a fixed grid, by the exact binomial (Clopper-Pearson) bound
of the share of good documents that they would reject, and testing stops at the first that
fails; as the sequence is fixed, only strata and measures need the multiple-testing
correction (Bonferroni). Of the certified cutoffs the one that best separates is taken, the
mildest of equals. Rejections of one stratum together stay within `alpha` with confidence
1 - `delta` over all strata.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"  # fixed value: characters that count as symbols
STRATA = ("en", "de", "fr", "es")  # a parameter: languages with cutoffs of their own; all others share one
STEPS = 100  # cutoffs of a measure
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"
SPACE = b" \t\n\r\x0b\x0c"


def measure(text: str | None) -> tuple[int, ...]:
    """The columns of MEASURES for one text (null: no words)."""
    import numpy as np
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    white = len(raw) - sum(map(len, words))
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    covered = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        if len(ids) < 1 << 21:
            windows = a[:-2] << 42 | a[1:-1] << 21 | a[2:]
        else:
            pairs = np.unique(a[:-1] << 31 | a[1:], return_inverse=True)[1]
            windows = pairs[:-1] << 31 | a[2:]
        _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
        hit = count[which] > 1
        mask = np.zeros(n, bool)
        for k in range(3):
            mask[k:n - 2 + k] |= hit
        covered = int(mask.sum())
    bare = len(raw.translate(None, SYMBOLS))
    return (n, len(text) - white, len(raw) - bare, repeated, covered, lines,
            len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(raw) - len(raw.translate(None, b"!?")))


def measures(text: Column) -> Column:
    """Struct of MEASURES of a text column; other columns stay outside Python."""
    names = [part.split()[0] for part in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in column], columns=names, dtype="int64")

    return run.asNondeterministic()(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rates(m: Column) -> dict[str, Column]:
    """Measures a rule can bound from above, each as a step from 0 to STEPS."""
    def step(top, bottom, scale):
        return F.when(bottom > 0, F.least(F.floor(top * STEPS / (bottom * scale)), F.lit(STEPS))).otherwise(F.lit(0)).cast("int")

    return {
        "symbols": step(m["n_symbols"], m["n_words"], 2),
        "repeated_lines": step(m["n_dup_lines"], m["n_lines"], 1),
        "repeated_words": step(m["n_repeat_words"], m["n_words"], 1),
        "capitals": step(m["n_capitals"], m["word_chars"], 1),
        "marks": step(m["n_marks"], m["n_words"], 2),
    }


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for i in range(1, 10_000):
            for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
                d = 1.0 + term * d
                c = 1.0 + term / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1 - x) / b


def certify(good: list[int], bad: list[int], alpha: float, delta: float) -> int | None:
    """The cutoff (reject steps above it) for histograms of good and bad documents by step, or None."""
    n, n_bad = sum(good), sum(bad)
    best, gain, k, hits = None, 0.0, 0, 0
    for cutoff in range(len(good) - 2, -1, -1):
        k += good[cutoff + 1]
        hits += bad[cutoff + 1]
        if n == 0 or n_bad == 0 or binomial_cdf(k, n, alpha) > delta:
            break
        if hits / n_bad - k / n > gain:
            best, gain = cutoff, hits / n_bad - k / n
    return best


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> dict[str, dict[str, int]]:
    """Cutoffs per stratum and measure. `measured`: doc_id, lang, m (see `measures`); labels: doc_id, quality.

    All labelled documents count that pass the base rules; a document with several labels is
    good only if all say so, labels without id or quality are left out. The histogram that
    reaches the driver has one row per stratum, measure and step, whatever the input.
    """
    truth = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    known = measured.join(truth, "doc_id").filter(~base_failed(F.col("m")))
    names = list(rates(F.col("m")))
    table = (
        known.select(stratum(F.col("lang")).alias("stratum"), "quality",
                     F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.alias("step")) for name, c in rates(F.col("m")).items()])).alias("x"))
        .groupBy("stratum", "x.name", "x.step")
        .agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
        .collect())
    tests = (len(STRATA) + 1) * len(names)
    out: dict[str, dict[str, int]] = {}
    for key in sorted({row["stratum"] for row in table}):
        for name in names:
            good, bad = [0] * (STEPS + 1), [0] * (STEPS + 1)
            for row in table:
                if (row["stratum"], row["name"]) == (key, name):
                    good[row["step"]] += row["good"]
                    bad[row["step"]] += row["bad"]
            cutoff = certify(good, bad, alpha / len(names), delta / tests)
            if cutoff is not None:
                out.setdefault(key, {})[name] = cutoff
    return out


def kept(m: Column, lang: Column, cutoffs: dict[str, dict[str, int]]) -> Column:
    """True for documents that pass the base rules and the certified cutoffs of their stratum."""
    values, rejected = rates(m), F.lit(False)
    for key, bounds in cutoffs.items():
        for name, cutoff in bounds.items():
            rejected = rejected | ((stratum(lang) == key) & (values[name] > cutoff))
    return ~base_failed(m) & ~rejected


def judged(measured: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, a row per row of `measured`.

    A null text has no words and fails the base rules; a null language falls into the shared
    stratum; without labels no cutoff is certified and the base rules alone decide. Rows are
    judged one by one: repeated ones alike, those without an id too.
    """
    m = F.col("m")
    base = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured.select("doc_id", *base, base_failed(m).alias("base_failed"), kept(m, F.col("lang"), cutoffs).alias("kept"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and m (see `measures`) of each row of `docs`, whole texts whatever their length.

    A null text counts as one without words; repeated rows give repeated rows; a null doc_id or
    lang stays null; other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "lang", measures(F.col("text")).alias("m"))
