"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import align, decontaminate, langid, linedup, mixing, neardup, pii, secrets, tokenstore, topk, transcripts, urlfilter, variants
from kbspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_store(table(spark, sf_dir, "documents"))


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.RULES)


ORACLE_SQL["op3_url_rules"] = urlfilter.oracle()


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domain_of(F.col("source")))


ORACLE_SQL["op10_source_mix"] = mixing.oracle()


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.session_key(spark))


@query
def op4_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.format_chats(table(spark, sf_dir, "conversations"))


@query
def op5_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL["op5_vector_top_k"] = topk.ORACLE


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_line_dedup"] = linedup.ORACLE


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
