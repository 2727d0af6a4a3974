"""From raw documents to token digests, in five stages that each call one text operator.

A stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; the
caller writes that as Parquet and hands it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, exact_dedup, mixing, ngram_join, toxicity
from millrace.llm.queries import read, tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs, keep="max")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard similarity of their 5-word shingles the one with the least doc_id stays."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share; a document may come several times or not at all."""
    return mixing.mix(docs, places=False)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy that the mix holds."""
    return bpe.round_trip(docs, *tokenizer()).drop("whole")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", byte_bpe_stage),
]

#: The toxicity models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        before, docs = docs, common.stash(kept, name.replace(" ", "-"))
        common.release(before, kept)
    return STAGES[-1][1](spark, docs, sf_dir)
