"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, elkan, infilling, itq, lines, mixing, packing, secret_spans, sharding, simhash, toxicity, url_rules, warc
from .common import table


def op1_itq_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.find_secrets(table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_removed, removed, text): removed are the places of the lines taken out, from 0."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), places=True).select("doc_id", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"), "text")


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.telephony_columns(table(spark, sf_dir, "documents"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.compressed_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(infilling.fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_itq_near_dup, op2_warc_bundles, op3_mix_budgets, op4_lpt_shards, op5_toxicity, op6_simhash_groups, op7_secrets, op8_fuzzy_lines, op9_packed_sequences, op10_telephony, op11_url_rules, op12_elkan_codes, op13_fill_in_middle)}
