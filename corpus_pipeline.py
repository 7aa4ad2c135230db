"""A corpus cleaned in five stages; each works on all rows that the stage before it kept.

language: texts in no learned language go. near_copies: one document (the smallest id) of each group of similar ones
stays. repeats: repeated lines and sentences are cut, texts of which nothing is left go. benchmark: documents that
hold a window of a benchmark item go. tokens: the rest is encoded and decoded.

Texts that are null or have no letter go with the first stage. Rows without an id stay in near_copies, equal ones too,
as no smallest id can stand for them; rows that share an id are told apart by their texts. Items without an id or
words match nothing. Empty tables give no rows. Other columns of documents stay as they are until the last stage,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import bpe, decontaminate, jaccard, language, units
from cladeframe.llm.common import prepare, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return units.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

#: The classifier and the tokenizer's merges are not expressible in SQL; the tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents of sf_dir; what a stage returns is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
