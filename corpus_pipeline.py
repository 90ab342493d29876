"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, source mixing, token store.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, langid, mixing, neardup, tokenstore
from kbspark.llm.common import discard, materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language models reject: no letter, or far from every learnt language."""
    model = langid.fit(docs.filter(langid.train_rows(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest doc_id."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects each leaf's prefix, in ids of the tokenizer, from its seeded epochs; a second epoch repeats documents."""
    counted = tokenstore.with_token_counts(docs.select("doc_id", "lang", "source", "text"))
    return mixing.mixed_documents(docs, mixing.domain_of(F.col("source")), counted=counted)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store; returns what reading it back yields for every document."""
    return tokenstore.token_store(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: The language models, the sketches and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        now = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            now = materialise(now, "stage")
        # The token store is written by now, too: nothing reads the stage before again.
        discard(docs)
        docs = now
    return docs
