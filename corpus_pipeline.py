"""The corpus pipeline: toxicity, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, folder of the tables), works on all rows that the one
before kept, and returns the columns of ``documents``; the last returns the packed
pieces. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import packing, secret_scan, simhash_dedup, source_mix, toxicity
from ledgerlight.llm.cluster import free_name, materialize
from ledgerlight.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, each by its own text. It learns from all labelled documents; null and empty texts and rows with null or shared ids stay unless their own text is toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (null last), then of the smallest hash of its text. Texts without words are one group."""
    return simhash_dedup.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null texts null."""
    return secret_scan.redact(docs, secret_scan.train_for(docs), path_col="source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in its shards' order; those without words are not drawn unless a whole copy of their source is."""
    names = [free_name(n, docs.columns) for n in ("shard", "shard_order")]
    mixed = source_mix.mix(docs, shard_col=names[0], order_col=names[1])
    return mixed.repartition(names[0]).sortWithinPartitions(*names).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null text is one piece, the end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_documents),
]

#: No stage but the masking of fixed patterns could be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
