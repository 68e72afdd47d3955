"""Queries of the numbered operators over whole tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark.llm import (
    embeddings,
    filter_audit,
    html_extraction,
    lm_scoring,
    merkle,
    mixing,
    oracle,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepieces,
    simhash,
    token_counts,
)
from housemark.llm.tables import remainder, table
from housemark.sources.scratch import stage

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = stage(simhash.with_fingerprints(docs).drop("text"), "marked")
    return simhash.near_duplicates(marked).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    counted = quality_rules.with_statistics(docs).drop("text")
    return quality_rules.with_verdict(counted).drop("lang", "source", "distance")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("secrets", lambda x: x["kind"] != "learned")
    return secrets.with_spans(docs).select(
        "doc_id",
        *(secrets.count("secrets", k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs).drop("text")


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_extraction.with_text(table(spark, folder, "pages"))
    return pages.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    described = stage(quality_classifier.with_statistics(docs).drop("text"), "described")
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    classes = quality_classifier.fit(described.where(~held_out).join(labels, "doc_id"), "quality")
    return quality_classifier.with_scores(described, classes).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.LEAST_SCORE).cast("int").alias("predicted"),
    )


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, remainder(F.col("doc_id"), 7) == 2)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = stage(mixing.measured(docs).drop("text"), "sized")
    return mixing.with_copies(sized).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return filter_audit.audit(stage(filter_audit.cells(docs, labels), "cells"))


def op12_sentencepieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentencepieces.with_ids(docs, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return merkle.manifest(
        docs,
        ["doc_id", "source", "lang", "n_chars", "text"],
        tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
        changes={"n_chars": one_more},
    ).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_quality_rules": op3_quality_rules,
        "op4_secrets": op4_secrets,
        "op5_token_counts": op5_token_counts,
        "op6_html_extraction": op6_html_extraction,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_embeddings": op8_embeddings,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_mixing": op10_mixing,
        "op11_filter_audit": op11_filter_audit,
        "op12_sentencepieces": op12_sentencepieces,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force or held-out rows."""
    return {
        "op3_quality_rules": oracle.quality_rules_sql(),
        "op10_mixing": oracle.mixing_sql(),
        "op11_filter_audit": oracle.filter_audit_sql(),
        "op13_merkle": oracle.merkle_sql(),
    }
