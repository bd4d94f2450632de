"""Corpus pipeline: toxicity filter, near duplicates, secret scan, mixing to target weights, packing.

Every stage is written to the folder that all executors share and read again as the next one's documents. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio.llm import jaccard, mixing, packing, secretscan, toxicity
from panelfolio.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more leave. The model learns from the same ids as query op10."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) != 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.drop_toxic(docs, model, 0.7).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarities of 0.8 or more connect, the document with the smallest id stays."""
    return jaccard.keep_one(docs, 0.8).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [SECRET], and n_chars follows the text; a null text stays null."""
    found = secretscan.scan(docs, secretscan.train(secretscan.samples(docs)))
    text = F.when(F.size("spans") > 0, secretscan.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their rows; a document occurs as often as it was drawn."""
    return mixing.mix(docs, mixing.tempered(docs, 0.5), seed=7).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

# Kneser-Ney scoring, components of near duplicates and tokenised packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
