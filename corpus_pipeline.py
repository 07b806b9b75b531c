"""Corpus pipeline: quality, exact copies, near copies, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept.
All but the last return the columns of ``documents``; the last returns the packed pieces. A
document that the mix takes twice is two rows, and is packed twice. Stages are written as
Parquet to the shared folder and read back, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import exact_dedup, mixing, packing, quality_gam, simhash
from riskloom.llm.common import stage, table

LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on the labelled ones, does not reject."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_gam.score(model, F.col("text")) >= LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that of the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id."""
    return simhash.near_dedup(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.Mix(docs, weights=(5, 2, 1), share=1.5, max_copies=2.0).apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: tokens and trained scores cannot be said in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
