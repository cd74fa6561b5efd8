"""The thin queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, clusters, decontaminate, hpylm, jaccard, licenses, mixing, passages, pii, quality, search, toxicity, vectors
from shelfspark.llm.common import table

#: Production parameters of the mixture.
MIX_SEED = 20260
MIX_PERCENT = 60
MIX_WEIGHTS = {
    "domain": {"web": 5, "books": 3, "forum": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: domain_of in DuckDB.
DOMAIN_SQL = "CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]{1,9}$') THEN ['web', 'books', 'forum'][CAST(substr(source, 4) AS BIGINT) % 3 + 1] ELSE 'other' END"


def mix_budget() -> Column:
    """The mixture's tokens: MIX_PERCENT of all, rounded down; an aggregate over tokens."""
    return F.expr(f"coalesce(sum(tokens), 0) * {MIX_PERCENT} div 100")


def domain_of(source: Column) -> Column:
    """documents has no domain: sources are dealt to three by the number in their name, others are 'other'."""
    number = F.try_to_number(F.regexp_extract(source, r"^src([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (number % 3 + 1).cast("int")), F.lit("other"))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.n_tokens(F.col("text")).alias("tokens"))
    budget = mix_budget()
    return mixing.select_tokens(counted, MIX_WEIGHTS, budget, MIX_SEED)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("license_sentences").cast("long").alias("n_license_sentences"),
        F.array_join("license_sentences", ",").alias("license_sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.BASE_KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(coded, RANKS)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    taught = toxicity.teaching_rows(docs, labels, "doc_id", "text", "toxic", ~held)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(*taught))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    named = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixture, op2_vectors, op3_licenses, op4_passages, op5_pii, op6_quality, op7_lm, op8_jaccard, op9_bpe, op10_toxicity, op11_clusters, op12_decontaminate, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixture": mixing.oracle(MIX_WEIGHTS, MIX_PERCENT, MIX_SEED, DOMAIN_SQL),
        "op3_licenses": licenses.oracle(),
        "op6_quality": quality.oracle(),
        "op11_clusters": clusters.oracle(),
        "op12_decontaminate": decontaminate.oracle(),
        "op13_search": search.oracle(),
    }
