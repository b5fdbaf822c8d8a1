"""A training corpus from the documents table, in stages; each is written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. Mixing repeats rows, so doc_id repeats from there on.

Defined results, of every stage: an empty table gives an empty one; null texts count as empty and null sources as a source;
rows that repeat, or share a doc_id, are rows of their own where the stage doesn't compare texts, and copies where it does;
columns whose names clash with those of an operator pass unchanged; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, exact_dedup, mixture, ngram_join, quality
from spanforge.llm.common import cut, documents
from spanforge.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Without usable labels all stay; an empty or null text is scored
    as any other; rows with the same doc_id are each scored; an empty table stays empty."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that with the largest doc_id (null is smallest); null texts and empty ones are one
    group; of rows with the same text and doc_id exactly one stays; an empty table stays empty."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of linked texts, that with the smallest doc_id (null only where all are null); blank and null texts
    are linked with nothing and all stay; of rows with the same doc_id in a group one stays; an empty table stays empty."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows with the same doc_id draw alike; documents of sources without words
    aren't taken; a null source is a source; an empty table stays empty."""
    return mixture.emit(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each row; null texts are empty
    and have no ids; an empty table gives an empty result."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs


#: The classifier, the join and the encoding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
