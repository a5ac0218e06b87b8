"""A training-data pipeline over ``documents``: toxicity, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecfold.llm import mixing, near_copies, packing, queries, secret_scan, toxicity
from vecfold.plans.lineage import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model predicts; its labels come from all of ``documents``."""
    model = queries.toxic_model(spark, sf_dir, queries.table(spark, sf_dir, "documents"))
    return docs.select(*COLUMNS).filter(toxicity.score(model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents link by fingerprint, as in ``op9_simhash``, and by five-word Jaccard of 0.8 or more.
    """
    return near_copies.one_per_group(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.masked(docs.select(*COLUMNS), public_tokenizers.path(queries.SECRET_VOCABULARY))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of fixed length."""
    return packing.pack(docs, public_tokenizers.path(queries.PACKING_TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# The model, the fingerprints and the tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
