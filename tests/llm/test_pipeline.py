"""The pipeline against a plain version, and the registry."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from barloom.llm import quality_rules, queries, secret_owners
from tests.llm.test_documents import plain_measures, plain_secrets
from tests.llm.test_near_dedup import plain_kept
from tests.llm.test_tokens import packs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet").cache(), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def test_quality(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    fine = set()
    for r in steps[0].collect():
        n = plain_measures(r.text)
        if not (n[0] < 50 or 100 * n[4] > 50 * n[0]):
            fine.add(r.doc_id)
    assert kept == fine  # too few labels at this size to certify a cutoff
    assert steps[1].columns == steps[0].columns


def test_dedup(steps):
    assert sorted(r.doc_id for r in steps[2].collect()) == plain_kept([(r.doc_id, r.text) for r in steps[1].collect()])
    assert steps[2].columns == steps[0].columns


def test_secrets(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys() and steps[3].columns == steps[0].columns
    owners = defaultdict(set)
    spans = {}
    for i, r in before.items():
        base = secret_owners.base_spans(r.text)
        spans[i] = base, secret_owners.candidates(r.text, base)
        for s in base + spans[i][1]:
            owners[s[3]].add(r.source)
    for i, r in before.items():
        text = list(r.text)
        taken = [(a, b) for _, a, b in plain_secrets(r.text)] + [s[1:3] for s in spans[i][1] if len(owners[s[3]]) <= 2]
        for a, b in taken:
            text[a:b] = "*" * (b - a)
        assert after[i].text == "".join(text)


def test_packing(steps):
    assert packs(steps[4].collect()) > 0
    assert {r.doc_id for r in steps[4].collect()} == {r.doc_id for r in steps[3].collect()}


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, steps[4].select(columns).collect()))


def test_odd_rows(spark, odd):
    """Stages take what operators take, repeated rows and rows without an id too."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == odd.columns
    rows = [r.doc_id for r in docs.collect()]
    assert len(rows) == len(set(rows))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.filter("false"), SMALL).count() == 0


def test_rows_without_id(spark):
    """Near copies without an id are found too; different texts of one id both stay."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " more"), (None, text), (5, "some other words " * 3), (5, "not like the former text at all"), (7, text + " x"), (5, "some other words " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == [5, 5, 7]


def test_certified_stage(spark, tmp_path):
    """With labels enough, junk goes and good documents stay."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" + ("***" if i % 10 == 0 else "") for _ in range(60)), "en", "src", 1) for i in range(6000)]
    spark.createDataFrame([(r[0], int(r[0] % 10 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(6000) if i % 10}


def test_registry():
    names = [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES]
    assert names == [str(n) for n in range(1, 14)]
    assert quality_rules.STRATA and [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def moved(df):
    """Rows that go into shuffles while `df` is collected."""
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name, metrics = plan.nodeName(), plan.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            rows += metrics.apply("shuffleRecordsWritten").value()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


@pytest.fixture
def large(spark):
    """Joins as with tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay(spark, large, monkeypatch):
    """Texts without a duplicate or a secret are not shuffled, labels meet measures instead of texts."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1500)]
    texts += [texts[0], texts[1] + " more", "password = hunter2hunter2 " + texts[2]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()
    docs.count()
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert moved(kept) < 200
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in (1500, 1501, 1502)]
    masked = corpus_pipeline.secrets(spark, docs, SMALL)
    assert moved(masked) < 200
    assert {r.doc_id: r.text for r in masked.collect()} == {i: t if i != 1502 else "*" * 25 + t[25:] for i, t in enumerate(texts)}
    seen, plain = [], corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    assert corpus_pipeline.quality(spark, docs, SMALL).count() == len(texts)
    assert len(seen) == 1 and "SortMergeJoin" not in seen[0]


def test_parted(spark):
    """Every row on one side, all keys among the former; without keys none."""
    from pyspark.sql import functions as F

    from barloom.llm.common import parted
    rows = spark.range(-500, 500).union(spark.createDataFrame([(None,)], "id long"))
    keys = spark.createDataFrame([(i,) for i in range(-500, 500, 7)] + [(None,)], "k long")
    some, rest = ({r.id for r in part.collect()} for part in parted(rows, F.col("id"), keys))
    assert {*range(-500, 500, 7), None} <= some and not some & rest and len(some | rest) == 1001 and len(some) < 200
    some, rest = parted(rows, F.col("id"), keys.filter("false"))
    assert (some.count(), rest.count()) == (0, 1001)
