"""Documents to packed training sequences: classify, filter by rules, drop near-duplicates, cut repeated passages, pack.

All stages work on whole tables and keep all columns; the last gives pieces. Null texts count as empty: the classifier may keep them, the
rules drop them. Rows with a null doc_id are judged by their text, are never near-duplicates and stay whole. Repeated rows are one
near-duplicate group. Very long texts are handled whole. An empty table goes through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import load, stored
from leafmill.llm.mil import keep_good
from leafmill.llm.packing import pack_documents, tokenizer_path
from leafmill.llm.rules import keep_passing
from leafmill.llm.simhash import keep_one
from leafmill.llm.substring import cut_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts; see keep_good for nulls, empty texts and empty tables."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; null and blank texts break one. See keep_passing."""
    return keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows with a null doc_id all stay. See keep_one."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; no row goes. See cut_repeats."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in their sequences; null and empty texts give one piece of the end id. See pack_documents."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packing),
]

#: The classifier is trained, and fingerprints and tokens have no SQL form; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again. An empty table gives no rows."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
