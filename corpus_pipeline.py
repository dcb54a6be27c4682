"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Every stage takes all that its predecessor kept and returns rows of the same
columns, but for the last, which returns what the token files hold.  No SQL
expresses SimHash groups or token ids, so there is no ORACLE_SQL; the tests
hold each stage against brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.op2_bitplane import round_trip
from strandwise.llm.op5_simhash import keep_one
from strandwise.llm.op6_mixing import mixed
from strandwise.llm.op7_quality import passing
from strandwise.llm.op8_decontaminate import without_benchmark
from strandwise.llm.storage import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return passing(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Fingerprints at two bits or fewer meet by the covering code of ``op5_simhash``; shingles decide those pairs and the rest.
    """
    return keep_one(spark, docs, shingle=5, similarity=0.8, bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return without_benchmark(spark, docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-plane token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return round_trip(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(spark, docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
