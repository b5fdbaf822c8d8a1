"""One query for each operator of this subpackage, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chroma, exact_dedup, line_spread, mixture, ngram_join, quality, token_count, url_rules
from .common import documents


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(documents(spark, sf_dir))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the UTF-8 bytes of each document's whole text are taken as its 8-bit samples."""
    return chroma.report(documents(spark, sf_dir))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(chat.with_hostile(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_mixture, op3_ngram_join, op4_url_rules, op5_chroma, op6_token_count, op7_bpe, op8_chat, op9_exact_dedup, op10_line_spread)
}

ORACLES: dict[str, str] = {
    "op2_mixture": mixture.oracle(),
    "op3_ngram_join": ngram_join.oracle(),
    "op4_url_rules": url_rules.oracle(),
    "op8_chat": chat.oracle(),
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op10_line_spread": line_spread.oracle(),
}
