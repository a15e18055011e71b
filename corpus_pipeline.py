"""A corpus pipeline of five stages, each calling one operator of ``spreadlens.llm`` on all that the stage before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the next. All but
the last return the columns of ``documents``; ``n_chars`` follows the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm import bpe_codec, decontaminate, simhash_dedup, suffix_dedup, toxicity
from spreadlens.llm.common import stage, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. The models learn from the labelled rows of all documents."""
    scorer = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, scorer)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash_dedup.first_of_groups(docs)


def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of windows that occur more than once are cut from the texts."""
    short = suffix_dedup.without_repeats(docs)
    return short.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    coded = bpe_codec.encode(docs)
    own = {"text", "n_tokens", "ids", "decoded", "decoded_sha256"}
    return coded.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own], "text", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_windows),
    ("benchmark decontamination", benchmark_items),
    ("bpe encoding", encode),
]

#: Models, hashes and merges are not for SQL; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
