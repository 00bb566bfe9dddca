"""Registered queries of the training-data operators, each over its whole table.

The conversations, rules and Merkle queries have SQL beside them. The others have none:
DuckDB has no XXH64, tokenizer, compressor or trained model. tests/llm holds them against
brute force, round trips and held-out labels.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    conversations, decontaminate, licenses, lm_scoring, merkle, mixing, oracles, packing, pii, quality, rules, simhash, toxicity, winnowing,
)
from .common import fold, ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op11_conversations": oracles.conversations_sql(), "op12_rules": oracles.rules_sql(), "op13_merkle": oracles.merkle_sql(),
}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(ready(spark), folder)

    QUERIES[build.__name__] = run
    return build


def _judged(scored: DataFrame, folds: int, apart: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == apart, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train_quality(docs, table(spark, folder, "labels"))
    return _judged(quality.score_quality(docs, model), quality.FOLDS, 0, quality.THRESHOLD)


@query
def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.fingerprint_documents(table(spark, folder, "documents"))


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, folder, "documents"))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_tokens(table(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), toxicity.FOLDS, toxicity.HELD_OUT, toxicity.THRESHOLD)


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find_personal_data(docs, pii.train_tagger(docs))


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        "page_id", licenses.url_path(F.col("url")).alias("path"), F.col("html").alias("text"))
    return licenses.scan_licenses(pages)


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_copies(table(spark, folder, "documents"), by_tokens=True)
    each = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))))
    return each.withColumn("copies", F.col("copies") + F.when(F.col("_row") <= F.col("_more"), 1).otherwise(0)).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.col("_source").alias("source"), "rate", "copies",
    )


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit_conversations(conversations.damage(table(spark, folder, "conversations")), present="present")


@query
def op12_rules(spark: SparkSession, folder: str) -> DataFrame:
    ledger = rules.write_ledger(table(spark, folder, "documents"))
    base = rules.rejects(rules.BASE)
    return ledger.select("doc_id", *rules.MEASURES[:5], base.alias("base_failed"), (~(base | rules.rejects(rules.CURRENT))).alias("kept"), "fails")


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = merkle.tampered_leaves(table(spark, folder, "documents"), tampered, lowered)
    found = merkle.verify(merkle.manifest(leaves))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
