"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe_codec,
    exact_dedup,
    line_dedup,
    lm_scoring,
    near_dedup,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    token_counts,
    turn_repair,
    warc,
    whitening,
)
from tidemark.llm.check_sql import EXACT_DEDUP, NEAR_DEDUP, QUALITY_RULES, WARC
from tidemark.llm.common import table, written
from tidemark.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
SHARDS = 40


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return secret_scan.scan(table(spark, sf_dir, "documents"), reviewed).select(
        F.col("id").alias("doc_id"), "start", "length", "value", "score", "is_secret"
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARDS).select(
        "row.doc_id",
        "size",
        F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents"), params=line_dedup.BY_GRAMS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, folder).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)
    ).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    # Stored between the two, so that a core has one dictionary at a time.
    encoded = written(bpe_codec.encode(table(spark, sf_dir, "documents"), path), "bpe-ids")
    return bpe_codec.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audits_after_damage(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_minhash_near_dedup,
        op3_quality_rules,
        op4_sharding,
        op5_token_counts,
        op6_line_dedup,
        op7_warc,
        op8_packing,
        op9_bpe_codec,
        op10_exact_dedup,
        op11_lm_scoring,
        op12_turn_repair,
        op13_whitening,
    )
}

CHECKS: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op7_warc": WARC,
    "op10_exact_dedup": EXACT_DEDUP,
}
