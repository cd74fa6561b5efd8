"""A training-data pipeline over documents: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows, written as Parquet and
read again, are the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, jaccard, mixing, pii, quality, queries
from shelfspark.llm.common import stored, table

#: Rows are given by no SQL: the stages use MinHash, regular expressions with checksums and a tokenizer.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word windows, similarity 0.8 or more)."""
    return jaccard.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by weight: a document as often as its source's epochs ask, the last one cut at the budget."""
    return mixing.mix_texts(docs, queries.MIX_WEIGHTS, queries.mix_budget(), queries.MIX_SEED, queries.domain_of(F.col("source")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, and whether they decode to its bytes."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.RANKS, public_tokenizers.PATTERN)
    slim = coded.select("doc_id", "lang", "source", "ids", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    both = bpe.decode(slim, queries.RANKS)
    exact = F.sha2("decoded", 256) == F.col("text_sha256")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
