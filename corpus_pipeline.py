"""The training-corpus pipeline: each stage works on all that its predecessor kept.

Quality rules drop junk, exact deduplication keeps one of equal texts, the n-gram join (five words, similarity
0.8) keeps one document of each group of near copies, the mix repeats or cuts documents by their source's
target and sorts them along the curriculum, and packing lays what is left into sequences. An empty table stays
empty through all stages; null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlake.llm.common import stage, table
from offerlake.llm.exact_dedup import ExactDedup
from offerlake.llm.mixing import Mix
from offerlake.llm.ngram_join import NgramJoin
from offerlake.llm.packing import pack
from offerlake.llm.quality import QualityRules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the log-likelihood ratio reject go."""
    return QualityRules(docs, table(spark, sf_dir, "labels")).kept_rows


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return ExactDedup(docs).kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    join = NgramJoin(docs, n=5, percent=80)
    kept = stage(join.kept, "pipeline-near")
    join.release()  # its sets are larger than the documents
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay, are cut or go by their source's target, in training order."""
    return Mix(docs).rows


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and place; a document that the mix repeats has pieces per repeat."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Models trained in tasks, hash-based indexes and packing have no SQL form; brute-force tests cover them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
