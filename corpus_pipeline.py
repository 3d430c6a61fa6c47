"""A training-data pipeline of four stages over the table documents.

Every stage works on all that the one before it kept; between stages documents are Parquet in
the shared checkpoint folder. Rejected documents go, one document of each near-duplicate group
stays, secrets are overwritten, and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import bin_packing, quality_rules, secret_owners, shingle_sets
from barloom.llm.common import cut, parted, table
from barloom.session import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Cutoffs are fitted on the labelled documents among `docs`; null texts have no words and go.
    Measures meet the labels, texts do not move.
    """
    cutoffs = quality_rules.fit(cut(quality_rules.measured(docs)), table(spark, sf_dir, "labels"))
    m = quality_rules.measures(docs["text"])
    return docs.withColumn("_measures", m).filter(quality_rules.kept(F.col("_measures"), F.col("lang"), cutoffs)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a 5-word Jaccard similarity of 0.8 or more.

    Texts are compared where SimHash trees link their fingerprints and where bands of minimum hashes agree.

    The one with the smallest doc_id stays, of equal ids the one with the smallest hash of its
    row; rows without an id come after all others. Rows that agree in all columns are one.
    """
    row = F.xxhash64("doc_id", "text", "lang", "source", "n_chars")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    roots = cut(shingle_sets.components(docs).select(F.col("key").alias("_key"), F.col("root").alias("_root")))
    copies = docs.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    some, alone = parted(docs, key, copies.select("_key").union(roots.select("_key")).union(roots.select("_root")))  # the latter have no duplicate and stay
    narrow = some.select("doc_id", row.alias("_hash"), key.alias("_key")).join(roots, "_key", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash"))["_hash"].alias("_hash")
    stays = narrow.groupBy(F.coalesce("_root", "_key")).agg(first).select("_hash")
    copy = F.row_number().over(Window.partitionBy("_hash").orderBy("_hash"))  # where the join puts them, so texts move once
    kept = some.withColumn("_hash", row).join(stays, "_hash", "left_semi").withColumn("_copy", copy)
    return kept.filter("_copy = 1").select(docs.columns).union(alone)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with base secrets and live-looking ones overwritten by asterisks of the same length."""
    return secret_owners.masked(docs, secret_owners.secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    return bin_packing.packed(docs, tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("secret_scan", secrets), ("best_fit_packing", packing)]

ORACLE_SQL = None  # SQL cannot tokenize, mix hashes or search bins; the tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
