"""As-of fills, extremes since an entry and name matching against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from barloom.functions import joins
from barloom.operators import news, trades

START = datetime.datetime(2024, 1, 31, 22)


def times(n, rng, step=37):
    return [START + datetime.timedelta(minutes=step * rng.randrange(n)) for _ in range(n)]


def test_calendar_fill_of_timestamps(spark):
    rng = random.Random(3)
    left = [(f"s{i % 3}", t) for i, t in enumerate(times(300, rng, 400))] + [("s0", START - datetime.timedelta(days=90))]
    right = {t: (rng.choice((None, rng.random())), rng.random()) for t in times(60, rng, 2000)}
    got = joins.asof_calendar(spark.createDataFrame(left, "symbol string, ts timestamp"),
                              spark.createDataFrame([(t, *v) for t, v in right.items()], "ts timestamp, vix double, pcr double"), {"vix": 15.0, "pcr": None})

    def known(t, k):
        past = [v[k] for u, v in sorted(right.items()) if u <= t and v[k] is not None]
        return past[-1] if past else (15.0, None)[k]

    assert sorted(map(tuple, got.select("symbol", "ts", "vix", "pcr").collect()), key=str) == sorted(((s, t, known(t, 0), known(t, 1)) for s, t in left), key=str)


def test_extremes_after_entry(spark):
    rng = random.Random(4)
    quotes = [(rng.choice("AB"), t, float(rng.randrange(100)), i) for i, t in enumerate(times(200, rng))]
    held = [(f"p{i}", rng.choice("ABC"), t) for i, t in enumerate([*times(40, rng), *[q[1] for q in quotes[:20]]])] + [("none", "A", None), ("p0", "A", START)]
    got = trades.extremes_after(spark.createDataFrame(held, "position_id string, symbol string, entry_ts timestamp"),
                                spark.createDataFrame(quotes, "symbol string, ts timestamp, price double, event_id long"))

    def plain(symbol, t):
        seen = [p for s, u, p, _ in quotes if t and s == symbol and u >= t]
        return (max(seen), min(seen)) if seen else (None, None)

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, s, t, *plain(s, t)) for i, s, t in held), key=str)


def test_names_inside_words(spark):
    rng = random.Random(5)
    names = ["AB", "ABC", "Acme Steel", "ZIND", "Steelworks", "steeL", "a", "xyzxyz", "LTDONE"]
    pieces = ["ab", "abc", "acme", "steel", "works", "xyz", "zi", "q", "\n", "one"]
    texts = [" ".join("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(6)) for _ in range(120)] + [None, "", "acme\tsteel", "acme steel"]
    articles = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    symbols = spark.createDataFrame([(n,) for n in names], "symbol string")
    got = {(r.doc_id, r.symbol) for r in news.mentions(articles, symbols).collect()}
    plain = articles.join(F.broadcast(symbols)).filter(news.is_relevant(F.col("text"), F.col("symbol")))
    assert got == {(r.doc_id, r.symbol) for r in plain.collect()} and len(got) > 50
