"""Queries over the corpus operations, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.ngramjoin import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.tokenfile import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return read_token_files(files)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"), least_bytes=0))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.suffixes import removal_report

    return removal_report(table(spark, sf_dir, "documents"), length=100)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.urlrules import judge_urls

    labels = table(spark, sf_dir, "labels")
    # outcomes of pages: good is a page of quality that is not toxic
    outcomes = labels.selectExpr("doc_id AS page_id", "CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS good")
    return judge_urls(table(spark, sf_dir, "pages"), outcomes)


def op8_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents"), depth=7)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.chat import as_replies, format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    return read_back(format_conversations(as_replies(turns.unionByName(extra))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narrascope.llm.pii import personal_data, report

    return report(personal_data(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from narrascope.llm.sql import ORACLE

    return dict(ORACLE)
