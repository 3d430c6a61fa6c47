"""The registered queries themselves, every contract column, on odd rows and the small table."""

import hashlib

import pytest

from barloom.llm import queries
from tests.llm import test_documents, test_pii
from tests.llm.conftest import SMALL
from tests.llm.test_tokens import bag


@pytest.fixture(scope="module")
def folder(spark, everything, tmp_path_factory):
    """A folder of tables: the odd rows, the small table, planted secrets and personal data."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(5000 + i, t, "en", "s", 1) for i, t in enumerate(test_pii.TEXTS)]
    rows += [(6000 + i, t, "en", s, 1) for i, t, s in test_documents.PLANTED]
    docs = everything.union(spark.createDataFrame(rows, everything.schema))
    docs.coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def counted(spans, kinds):
    return tuple(sum(s.startswith(k + ":") for s in spans) for k in kinds)


def test_op6(spark, folder, rows):
    got = queries.QUERIES["op6_personal_data"](spark, folder).collect()
    plain = [(r.doc_id, [s for s in test_pii.plain(r.text).split(",") if s]) for r in rows]
    kinds = ("email", "ip", "card", "phone")
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == bag((i, *counted(s, kinds), digest(s)) for i, s in plain)
    assert any(len(set(counted(s, kinds))) > 1 for _, s in plain)
    base = {digest(s): set(s) for _, s in plain}
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert base[r.base_sha256] <= set(spans)
        assert spans == sorted(spans, key=lambda s: (kinds.index(s.split(":")[0]), *map(int, s.split(":")[1:])))


def test_op9(spark, folder, rows):
    got = queries.QUERIES["op9_secret_owners"](spark, folder).collect()
    plain = [(r.doc_id, [f"{k}:{a}:{b}" for k, a, b in test_documents.plain_secrets(r.text or "")]) for r in rows]
    kinds = ("assign", "access", "hex")
    assert bag((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == bag((i, *counted(s, kinds), digest(s)) for i, s in plain)
    base = {digest(s): set(s) for _, s in plain}
    assert all(base[r.base_sha256] <= {s for s in r.spans.split(",") if s} for r in got)
    assert any("token:" in r.spans for r in got)


def test_op2(spark, folder, rows):
    got = queries.QUERIES["op2_quality_rules"](spark, folder)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    expected = []
    for r in rows:
        n = test_documents.plain_measures(r.text)
        expected.append((r.doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert bag(got.select(names).collect()) == bag(expected)
    assert got.filter("base_failed AND kept").count() == 0


def test_op7(spark, folder, rows):
    got = queries.QUERIES["op7_simhash_trees"](spark, folder).select("doc_id", "fingerprint", "component_id")
    assert bag(got.collect()) == bag(test_documents.plain_components([(r.doc_id, test_documents.plain_print(r.text)) for r in rows]))
