"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep
the columns of ``documents``. ``run`` writes every stage's rows to the shared folder and
reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallybridge.llm import bpe, compression, langid, minhash, mixing
from tallybridge.workspace import Workspace

SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    NULL and empty texts are rejected; rows that repeat an id are judged one by one; an
    empty table stays empty; columns of any other name pass through.
    """
    return langid.accepted_documents(docs, langid.train(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is not predicted toxic, whatever their id.

    NULL and empty texts are scored like any other; copies of a text share its fate; an
    empty table stays empty; columns of any other name pass through.
    """
    model = compression.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group that shares 0.8 of its five-word shingles: the one of its smallest id.

    Rows are grouped by their texts, with or without an id; NULL ids come last. Blank and
    NULL texts are in no group and all stay; of equal rows one stays; an empty table stays
    empty; columns of any other name pass through.
    """
    return minhash.without_near_duplicates(docs, SHINGLE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights ask for it.

    NULL and empty texts have no tokens and stay out; rows that repeat an id are documents
    of their own; an empty table stays empty; columns of any other name pass through.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to.

    NULL texts are encoded as empty ones; an empty table gives no rows.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language),
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("byte_level_bpe", token_ids),
]

# Models trained on the way and compressed lengths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.store(stage(spark, docs, sf_dir), name)
    return docs
