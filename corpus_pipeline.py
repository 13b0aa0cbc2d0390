"""A corpus pipeline over `documents`: quality, near-duplicates, benchmark passages, then tokens.

Each stage works on all its predecessor kept, and all but the last return the columns of documents. Nulls: a null text is
the empty one to every stage and is kept or rejected as such; a document without an id is never taken for another's copy
and stays unless its text is rejected. Repeated rows of one id are kept or dropped together. Empty tables stay empty.
Columns beyond those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import bpe, decontamination, quality, simhash
from sheaf.llm.common import table, written
from sheaf.llm.queries import split_pattern, tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, doesn't reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that a five-word similarity of 0.8 or more links, by their SimHash fingerprints, the one
    of least id. The README has the measured recall, and what else the fingerprints link."""
    return simhash.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, and digests of the ids and of what they decode to."""
    return bpe.round_trip_digest(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [("quality", good_documents), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("bpe", as_tokens)]

#: SQL can express none of a trained network, fingerprints by XXH64, or byte pair merging; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
