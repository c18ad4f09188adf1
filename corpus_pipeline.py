"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, byte-level BPE; each stage sees what its predecessor kept.

All stages but the last return the columns of their documents as they came, whatever their names, and keep rows with null texts or
ids, which hold nothing to object to; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, decontam, minhash, secret_scan, toxicity
from touchline.llm.common import modest, settle

#: The stages draw on fitted models and sketches that SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; of repeated rows all or none."""
    modest(spark)
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; of equal rows one. Shingles have five words, as the
    stages of this pipeline take them, op3's own query four; similarity is 0.8 or more."""
    modest(spark)
    return minhash.deduplicate(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; of repeated rows all or none."""
    modest(spark)
    return decontam.reject_leaks(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars follows; the documents stay."""
    modest(spark)
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them, a row for each document."""
    modest(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
