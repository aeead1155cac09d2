"""Registered queries of the document operators; their SQL is in ``oracle``."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, decontaminate, exact_dedup, hard_negatives, packing, pii, quality, secrets, simhash, suffix_dedup, token_counts, topk
from .common import documents, shared_path
from .oracle import ORACLE  # noqa: F401


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each call: everything is a miss, copies excepted."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"),
                                     shared_path(spark, "token-cache")).drop("digest")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.report(docs, pii.fit(docs))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_scores(docs, rules)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger for each call: every blob is unseen."""
    return secrets.report(secrets.secret_scan(documents(spark, sf_dir), shared_path(spark, "ledger")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.report(byte_bpe.encode(documents(spark, sf_dir), ranks))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    runs = F.transform("removed", lambda r: F.concat_ws(":", r["from"], r["to"]))
    return out.withColumn("removed", F.array_join(runs, ","))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("longest", "items", "runs")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_counts, op3_exact_dedup, op4_topk_search, op5_pii, op6_quality_classifier,
    op7_secret_scan, op8_simhash_dedup, op9_byte_bpe, op10_suffix_dedup, op11_decontaminate,
    op12_conversation_repair, op13_hard_negatives)}
