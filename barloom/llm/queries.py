"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    adaptive_scan,
    bin_packing,
    byte_bpe,
    context_mixing,
    incremental_clusters,
    license_index,
    quality_rules,
    secret_owners,
    simhash_trees,
    spelling_frontier,
    token_counts,
    url_templates,
    weak_pii,
)
from barloom.llm.common import cut, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality_rules.measured(table(spark, sf_dir, "documents")))
    return quality_rules.judged(measured, quality_rules.fit(measured, table(spark, sf_dir, "labels")))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its url names: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages")
    _, path = url_templates.host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?\z", 1).try_cast("long")
    worst = (table(spark, sf_dir, "labels").groupBy("doc_id")
             .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")))
    labels = pages.select("page_id", number.alias("doc_id")).join(worst, "doc_id").select("page_id", "bad")
    return url_templates.judge(pages, labels)


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return adaptive_scan.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.packed(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def spans_of(kind: int) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [spans_of(k).alias(f"n_{weak_pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(weak_pii.listed(F.col("base")), 256).alias("base_sha256"),
                        weak_pii.listed(F.concat("base", "added")).alias("spans"))


def op7_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op9_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_owners.secrets(table(spark, sf_dir, "documents"))
    counts = [spans_of(k).alias(f"n_{secret_owners.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secret_owners.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_owners.listed(F.concat("base", "added")).alias("spans"), "n_live", "n_copied")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def op11_spelling_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_frontier.variants(table(spark, sf_dir, "documents"))


def op12_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.licenses(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_clusters.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_url_templates, op4_nearest_vectors, op5_bin_packing,
                                   op6_personal_data, op7_simhash_trees, op8_byte_bpe, op9_secret_owners, op10_context_mixing, op11_spelling_frontier, op12_license_index, op13_centroid_clusters)}
SQL: dict[str, str] = {"op12_license_index": license_index.licenses_sql(), "op13_centroid_clusters": incremental_clusters.clustered_sql()}
