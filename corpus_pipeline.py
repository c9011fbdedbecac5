"""A corpus pipeline: language ID, near duplicates, repeated passages, source mix, tokens.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetry.llm import bpe, language_id, mixing, near_duplicates, passages
from sitemetry.llm.queries import tokenizer
from sitemetry.llm.runtime import checkpoint_folder, delete_folder, short_text_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no language holds most of the probability."""
    short_text_batches(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    short_text_batches(spark)
    return near_duplicates.keep_one_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; ``n_chars`` follows the text."""
    short_text_batches(spark)
    columns = [F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return passages.dedup_passages(docs).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the mix: its documents repeat or fall out by hash."""
    return mixing.replicate(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    short_text_batches(spark)
    return bpe.encode(docs, *tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: A network's predictions are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last is what the result reads.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_folder(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
