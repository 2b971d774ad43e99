"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

language ID -> quality rules -> near-duplicate removal -> mixing -> SentencePiece ids.
All stages but the last return the columns of documents; the last returns doc_id, source,
n_tokens and token_ids, one row for every copy that the mix takes.

Defined cases: null and empty texts, and those without letters, are of no known language
and go in the first stage; shorter ones than ten words go in the second. Null lang and
source values are strata of their own. Rows that repeat are judged alike, and the third
stage keeps one of them. Null doc_ids are documents like others. Columns beyond those of
documents, whatever their names, go through all stages but the last, which leaves them
out. Texts of any length are read whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgrain.llm.common import materialize
from callgrain.llm.langid import language_filter
from callgrain.llm.minhash import near_dup_filter
from callgrain.llm.mixing import mix
from callgrain.llm.pieces import encode_documents
from callgrain.llm.quality import quality_filter


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return language_filter(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs stay."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return near_dup_filter(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their target weights; a document taken twice is two rows."""
    return mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Models, signatures and transducers are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what the one before has kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
