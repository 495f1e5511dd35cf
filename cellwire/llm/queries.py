"""Registered queries of this folder: each operator over its whole table, with production parameters."""
from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellwire.llm import (
    audit_checks, checks, chosen_path, interpolation, langid, licenses, multi_index, packing, periodic, pieces, prefix_free, relative_lz,
    sharding, source_audit, vp_tree,
)
from cellwire.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, folder) -> DataFrame`` and, where given, its check."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_sharding", checks.SHARDING)
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and shard of every document among 64 shards."""
    lookup = sharding.lookup_table(spark, [f"shard-{k:02d}" for k in range(64)])
    return sharding.place(table(spark, folder, "documents"), "doc_id", lookup).select("doc_id", "slot", "shard")


@query("op2_license_scan", checks.LICENSES)
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The best licence template of every document and the number of its units that match any."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return pieces.digest(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document by a field fitted on labelled documents outside the held-out quarter."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op5_embedding_near_dedup", checks.LINKED)
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9 or more."""
    return multi_index.linked(table(spark, folder, "embeddings"))


@query("op6_suffix_array_dedup", checks.REMOVED_BYTES)
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that start in an earlier one."""
    return prefix_free.removed_bytes(table(spark, folder, "documents"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces with their place in sequences of at most 2048 tokens."""
    return packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_substring_dedup", checks.REMOVED_WORDS)
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the windows of 50 words that start in an earlier one."""
    return relative_lz.removed_words(table(spark, folder, "documents"))


@query("op9_vantage_point_search", checks.NEAREST)
def op9_vantage_point_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors of largest inner product of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    return vp_tree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op10_jaccard_join", checks.JACCARD)
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every document at a Jaccard similarity of 0.8 or more on word 5-grams."""
    return chosen_path.similar(table(spark, folder, "documents"))


@query("op11_periodic_runs", audit_checks.PERIODIC)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which get a periodic tail first."""
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(table(spark, folder, "documents"))))


@query("op12_source_divergence", audit_checks.SOURCES)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far every source diverges from the others of its language, and by which terms from the language."""
    return source_audit.audit(table(spark, folder, "documents"))


@query("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by words alone and by deleted interpolation of trigrams."""
    return interpolation.scored(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Language filter, near-duplicate removal, substring dedup and packing of the documents."""
    return corpus_pipeline.run(spark, folder)
