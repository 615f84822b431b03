"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import table


def tokenizer_path() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_llr import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_mil import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import document_rates

    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, find_secrets

    return digests(find_secrets(table(spark, sf_dir, "documents")))


def op5_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rangecoder import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cws import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import digests, encode_texts

    return digests(encode_texts(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import NearConfig, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), NearConfig(shingle=3, percent=85))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_mixture_rates, op4_secret_ledger, op5_range_coded_ids, op6_weighted_fingerprints, op7_shard_placement, op8_bpe_codec, op9_token_counts, op10_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    from . import secrets

    return {"op4_secret_ledger": secrets.oracle()}
