"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontam, minhash, packing, pii, toxicity
from claimloom.llm.common import cut, lookup, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model learns from the labels of ``sf_dir`` outside the held-out fold."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; rows with a null id stay."""
    gone = cut(minhash.near_texts(docs, width=5, threshold=0.8).where("not kept").select("doc_id").distinct(), "gone")
    return lookup(docs, gone, "doc_id", "left_anti")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in occurrences of benchmark windows are cut out of the texts; documents stay."""
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"), width=10, length_col="n_chars")


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; documents stay."""
    return pii.masked(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.packed(docs, capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
