import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, marks of all sorts."""
    rng = random.Random(3)
    words = ["the", "Käse", "it's", "x1y2", " ", "don't", "a\tb", "<|endoftext|>", "中文", "é", "12345", "***", "  ", "\n", "\n\n", "end."]
    long = " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(12_000))
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "A B C D", "same text of a few words here", "same text of a few words here",
             long, "z" * 70_000, "ab1" * 9_000, "ä" * 5_000, "w " * 3_000, "\x1c\x85x", "<|startoftext|>hi<|ENDOFTEXT|>", "\U0001f600 ok"]
    rows = [(i, t, "en", "src1", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[9], (None, "no id", None, None, None), (None, None, None, None, None), (90, "words without a language", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "m", "row", "rank", "length", "hash", "owner", "component_id", "n_tokens", "piece", "base", "spans", "kept", "_slot", "stratum", "value"):
        df = df.withColumn(name, F.lit("extra"))
    return df.cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def everything(odd, documents):
    """The odd rows and the small table."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return odd.select(columns).union(documents.withColumn("doc_id", documents["doc_id"] + 1000).select(columns)).cache()
