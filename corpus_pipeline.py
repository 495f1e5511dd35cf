"""A corpus pipeline over ``documents``: language filter, near duplicates, repeated substrings, packing.

Each stage reads what its predecessor wrote and works on all of it. All but the last return the columns
of ``documents``. Rows that share a doc_id are taken for one document and stay or go together.
"""
from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwire.llm import chosen_path, langid, packing, prefix_free
from cellwire.operators.session import drop_tables, materialize, stored_tables

# Tables that the last stage stored for itself. Its result is written when the next stage begins.
_LEFT: list[str] = []


def _stage(work):
    """A stage that first deletes what the stage before it stored on the way."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _LEFT)
        _LEFT.clear()
        before = set(stored_tables())
        out = work(spark, docs, sf_dir)
        _LEFT.extend(t for t in stored_tables() if t not in before)
        return out

    return run_stage


# A text whose words are on average less certain than this to be of its language has none. Texts that mix two
# languages lie above it.
LEAST_SCORE = 0.35


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language.

    Texts that are null or have no letter go, and those that the field places with a score below
    ``LEAST_SCORE``. Where no row has a language to learn from, every document stays.
    """
    field = langid.fit(docs)
    if field.labels == [langid.UNKNOWN]:
        return docs
    found = langid.language(field, spark)("text")
    return docs.withColumn("_found", found).where(
        (F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE)).drop("_found")


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; documents without an id stay."""
    kept = chosen_path.similar(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    with_id = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return with_id.unionByName(docs.where("doc_id IS NULL"))


@_stage
def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that start in a document of smaller id."""
    return prefix_free.deduplicated(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeated_strings),
    ("best_fit_packing", packed),
]
# Token ids and the language model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are a stored table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
