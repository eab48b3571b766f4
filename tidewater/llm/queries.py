"""Registered queries of the dealt operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import language, oracles, quality
from tidewater.llm.centroids import cluster_vectors
from tidewater.llm.common import documents
from tidewater.llm.decontaminate import find_contamination
from tidewater.llm.fingerprints import compare_with_next, written
from tidewater.llm.importance import resample
from tidewater.llm.jaccard_join import jaccard_components
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import pack_documents
from tidewater.llm.personal_data import BASE, find_personal_data, listed
from tidewater.llm.phrase_dedup import remove_repeated_words
from tidewater.llm.sharding import shard
from tidewater.llm.suffix_dedup import remove_repeated_bytes
from tidewater.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(use_utc(spark), sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, sf_dir))


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that was fitted without the held-out third."""
    docs = documents(spark, sf_dir).select("doc_id", "text", quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.filter("NOT held_out"), labels)
    return quality.scored(docs, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by machines that were fitted without the held-out quarter."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "lang", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out")
    )
    model = language.train(docs.filter("NOT held_out"))
    return language.predicted(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_winnowing_decontamination", oracles.DECONTAMINATION)
def winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_minhash_near_dedup", oracles.NEAR_DUPLICATES)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir))


@query("op6_weak_supervision_pii")
def weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digests of the base kinds, and all spans."""
    found = find_personal_data(documents(spark, sf_dir), keep=["doc_id"])
    counts = [F.expr(f"CAST(size(filter(found, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    base = F.sha2(F.expr(listed("found", "s.base")).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(listed("found")).alias("spans"))


@query("op7_weighted_sampling_fingerprints")
def weighted_sampling_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike neighbours are."""
    found = compare_with_next(documents(spark, sf_dir))
    return found.withColumn("fingerprint", written("fingerprint")).withColumn(
        "edited_fingerprint", written("edited_fingerprint")
    )


@query("op8_jump_hash_shards")
def jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by doc_id; grown_shard is the place among 25."""
    payload = [
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    ]
    return shard(documents(spark, sf_dir), "doc_id", SHARDS, payload).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query("op9_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing 50-byte strings that also start in a smaller document."""
    return remove_repeated_bytes(documents(spark, sf_dir), digest=True)


@query("op10_repeated_phrase_dedup", oracles.REPEATED_WORDS)
def repeated_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 20-word windows that also start earlier."""
    return remove_repeated_words(documents(spark, sf_dir), digest=True)


@query("op11_orchard_centroid_clustering", oracles.CENTROIDS)
def orchard_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all whole vectors after ten rounds."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_bit_sliced_importance_resampling", oracles.RESAMPLING)
def bit_sliced_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the benchmark's distribution."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_multi_order_jaccard_join", oracles.JACCARD_JOIN)
def multi_order_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over links of a similarity of 0.9 on three-word shingles."""
    return jaccard_components(documents(spark, sf_dir))
