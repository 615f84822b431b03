"""A corpus pipeline: quality, near copies, secrets, mixture, token ids.

Each stage takes the rows that the one before it kept, and its decisions take
effect on them.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm._shared import Scratch, table
from gleanery.llm.bpe_automaton import digests, encode_texts
from gleanery.llm.minhash import NearConfig, drop_near_duplicates
from gleanery.llm.mixing import MixConfig, mix
from gleanery.llm.quality_llr import keep_good
from gleanery.llm.queries import tokenizer_path
from gleanery.llm.secrets import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Clean text stays whole; what is probably poor or toxic is thinned out.
MIX = MixConfig(targets={"clean": 1.0, "low": 0.5, "toxic": 0.25}, multiples=True, most=1.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word windows, 0.8 or more alike."""
    return drop_near_duplicates(docs, NearConfig(shingle=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with their rate's probability, drawn by id; clean ones have a rate of 1."""
    return mix(docs, table(spark, sf_dir, "labels"), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding, as digests."""
    return digests(encode_texts(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: Neither the near-copy groups nor the token ids have an SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
