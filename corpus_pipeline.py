"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage is a function of (session, documents, folder of tables) whose result is written as Parquet and read again as the
documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_radar.llm.minhash import keep_representatives
from listing_radar.llm.packing import pack
from listing_radar.llm.quality_rules import keep_good
from listing_radar.llm.queries import vocabulary
from listing_radar.llm.storage import stage
from listing_radar.llm.suffix_dedup import remove_repeats
from listing_radar.llm.toxicity import reject_toxic


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as not toxic; the model learns from the labelled ones among ``docs`` that are not held out."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_representatives(docs, size=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of passages of 200 bytes or more; the first copy stays."""
    return remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learnt and the tokenizing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
