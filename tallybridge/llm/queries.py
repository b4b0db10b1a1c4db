"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybridge.llm import (
    bpe,
    compression,
    divergence,
    divergent_sources,
    interpolation,
    kmeans_tree,
    langid,
    minhash,
    mixing,
    neighbours,
    quotes,
    repair,
    rtree,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents"))


def op5_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def op6_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op7_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.score_documents(docs, compression.train(docs, table(spark, sf_dir, "labels")))


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    found = langid.identify_pages(table(spark, sf_dir, "pages"), model)
    rounded = [F.round(c, 6).alias(c) for c in ("posterior", "text_posterior")]
    return found.select("page_id", "lang_id", *rounded, "accepted")


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_str_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergent_sources.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_deleted_interpolation,
        op2_quotation_linking,
        op3_nn_descent,
        op4_distribution_divergence,
        op5_two_tier_bpe,
        op6_hierarchical_budgets,
        op7_compression_distance,
        op8_repair_shards,
        op9_evidence_fusion,
        op10_circulant_minhash,
        op11_kmeans_tree,
        op12_str_rtree,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op6_hierarchical_budgets": mixing.ORACLE,
    "op12_str_rtree": rtree.ORACLE,
    "op13_source_divergence": divergent_sources.ORACLE,
}
