"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing. Each stage takes (spark, docs, sf_dir).

Every stage works on all rows of docs, in any column order and with any further columns, which it hands on untouched but for
n_chars, which follows the text. Null and blank texts go in the first stage. Rows without a doc_id are documents of their own;
rows that share one are judged each by the first stage, share the second's decisions and stay together in the third. An empty
table stays empty. Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import jaccard, linededup, pack, quality
from tideline.llm.common import stored, table
from tideline.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that the rules reject."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier line repeats within one edit, and documents that keep no word."""
    return linededup.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    return pack.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("best_fit_packing", packing)]

#: SQL has no tokenizer; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
