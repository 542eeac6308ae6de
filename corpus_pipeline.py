"""Corpus pipeline: quality, near copies, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tempoweir.llm.common import freed, remove, shared_dir
from tempoweir.llm.jaccard_join import keep_one
from tempoweir.llm.pfair_mix import interleave
from tempoweir.llm.pii_surrogates import hide_pii
from tempoweir.llm.quality_pu import keep_good
from tempoweir.llm.template_decontam import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the PU classifier takes for good ones."""
    return keep_good(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return keep_one(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(spark, docs, sf_dir)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return hide_pii(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and position in the mix of sources."""
    return interleave(spark, docs, sf_dir)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: A fitted model, a similarity join and keyed surrogates have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again.

    What a stage wrote is deleted once the next one has written its own, so that two
    copies of the corpus are held at most; the last one stays.  Shuffle files go with the
    query that made them.  Null texts and ids,
    repeated rows, empty tables and further columns go through every stage as its docstring says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{root}/{k}"
        made = stage(spark, docs, sf_dir)
        with freed(spark):
            made.select("*").write.parquet(out)
        if k:
            remove(spark, f"{root}/{k - 1}")
        docs = spark.read.parquet(out)
    return docs
