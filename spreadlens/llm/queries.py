"""Registered queries of the operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, decontaminate, fill_in_middle, lm_score, periodic_runs, quality_cnn, quality_rules, simhash_dedup, suffix_dedup, token_count, toxicity, warc
from ..session import scratch_path
from .common import table, whole_text, words
from .oracle import ORACLE  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one with control strings; every figure is read back from the formatted string."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat_format.format_chats(chat_format.conversation_events(conv.unionByName(odd)))
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        out.withColumns({"_turns": chat_format.parse(F.col("formatted")), "_loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))})
        .select(
            "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.removals(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the contract asks for it, the words from one on repeat a stretch of the words."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    rows = docs.select("doc_id", whole_text().alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    asked = F.col("h") % 10 == 0
    rows = rows.withColumn("w", F.when(asked, words(F.col("text")))).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    rows = rows.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    new = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(asked & (F.col("n") > 0), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start and period, so the first of equals stays
    best = F.reduce("runs", none, lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest are those of the payloads read back."""
    folder = scratch_path(spark, "op12-archive")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.parse(warc.read(spark, folder)).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_score": op3_lm_score,
    "op4_chat_format": op4_chat_format,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_token_count": op10_token_count,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
}
