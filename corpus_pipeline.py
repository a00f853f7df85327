"""A corpus pipeline over the operators in larkspur.llm: toxic documents go, then copies, then near copies; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, packing, simhash, toxicity
from larkspur.llm.common import superseded, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones outside the held-out fifth, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.dedup(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash of five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.dedup(docs, width=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, sources in proportion."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("simhash", drop_near), ("packing", pack)]

#: SQL cannot express a fitted model or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage is written and read again, and deleted once the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        superseded(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
