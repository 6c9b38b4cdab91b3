"""From raw documents to an encoded training corpus, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage
reads it. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, langid, mixing, simhash, substring
from vellum.llm.common import in_written_order, settled
from vellum.llm.queries import vocabulary


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, or under half of the probability."""
    return langid.keep_identified(docs, vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has as well are cut out of the text."""
    return substring.without_repeats(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix of sources."""
    return mixing.keep_mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every document in the mix, in the order in which the mix was written."""
    return bpe.encode_documents(in_written_order(docs), vocabulary("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("language_id", told_language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", target_mix),
    ("bpe", encoded),
]

#: SQL expresses neither the learned language model nor the subword encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last; rows are in the order of the mix.

    What a stage's operator writes on the way is deleted once the stage's own result is written. The
    results of stages stay until ``vellum.llm.common.release`` is called.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
