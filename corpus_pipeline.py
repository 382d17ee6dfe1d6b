"""Corpus pipeline: quality classifier, near-duplicates, mixing, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoweave.llm.common import materialise, table
from ontoweave.llm.kneser_ney import keep_quality, trusted_documents
from ontoweave.llm.mixing import WEIGHTS, mix, source_domain
from ontoweave.llm.packing import default_vocabulary, pack_documents
from ontoweave.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; labelled good documents train it."""
    return keep_quality(docs, trusted_documents(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a similarity of 0.8 or more of five-word shingles."""
    return drop_near_duplicates(docs, k=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, divided by domain and language weights; no document is repeated."""
    return mix(docs, source_domain(), share=0.8, epochs=1, weights=WEIGHTS, carry=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of at most 1024."""
    return pack_documents(docs, default_vocabulary(), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: The classifier, SimHash and the tokeniser can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
