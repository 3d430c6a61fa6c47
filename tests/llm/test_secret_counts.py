"""Secrets: values repeated within one owner, and documents without an owner."""

from barloom.llm import secret_owners

TOKEN = "ghp_AAAABBBBccccDDDD11112222%02d"


def test_repositories_and_unknown_owners(spark):
    rows = [(i, f"use {TOKEN % 1} here", "hot") for i in range(30)]  # one source
    rows += [(100 + i, f"use {TOKEN % 2} here", None) for i in range(3)]  # three documents without a source
    rows += [(200, f"mine {TOKEN % 3}", None), (200, f"mine {TOKEN % 3}", None), (201, f"mine {TOKEN % 4}", "hot")]
    rows += [(None, f"use {TOKEN % 5} here", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secret_owners.secrets(docs).collect()
    assert sorted((r.doc_id, len(r.added), r.n_live, r.n_copied) for r in out if r.doc_id in (200, 201)) == [(200, 1, 1, 0)] * 2 + [(201, 1, 1, 0)]
    rest = [r for r in out if r.doc_id not in (200, 201)]
    assert len(rest) == 36 and all((r.added, r.n_live, r.n_copied) == ([], 0, 1) for r in rest)
