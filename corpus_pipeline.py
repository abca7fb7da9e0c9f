"""The corpus pipeline: five stages over `documents`, each by one operator of veriloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes each stage's
rows as Parquet in the folder that driver and executors share and rereads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from veriloom.llm.common import cut, discard

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers while encoding, next to what earlier stages left in its memory.
CACHED_PIECES = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; without usable labels none does."""
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks the longest stays, of equals the one of the least id."""
    return exact_dedup.keep_one_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts that links of five-word Jaccard similarity 0.8 connect the one of the least id stays; texts without words all do."""
    return jaccard.keep_one_of_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule: each document as often as it is taken, once, twice or not at all.

    Only the one document at which a source's stream stops is taken in part; it counts when half of it or more is.
    Documents without words stay, once each, at the end.
    """
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    coded = bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, cached=CACHED_PIECES)
    return coded.withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram jaccard join", drop_near_copies), ("source mixing", mix_sources), ("byte-level bpe", encode)]

#: The stages for toxicity, near copies and BPE aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        last, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(last)
    return docs
