"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

language ID -> near-duplicate removal -> benchmark decontamination -> masking of personal data -> packing.

Every stage works on all rows its predecessor kept.  The first four return the columns of ``documents``;
the last returns the packed pieces with
their token ids.  Written tables between stages mean that a lost executor never
replays an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontam, langid, packing, pii, simhash
from claimweave.llm.common import discard, durable, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go."""
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go; ``n_items >= 2`` is the flag of op6 alone."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is masked."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("private data", mask_private_data),
    ("best-fit packing", pack_sequences),
]

#: Trained models and local search take part, which SQL can't express; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = durable(stage(spark, docs, sf_dir), f"stage-{n}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
