"""The stages of the corpus pipeline, each one operator of this subpackage over all rows it is given.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return
the columns of ``docs``, whatever further ones there are, and ``n_chars`` is made
true of the text again where a stage rewrites it.

Defined cases: a null text stays null until packing, where it is empty; empty
texts are near-duplicates of each other, so one of all stays; texts of any
length are taken whole; of repeated rows and of ties between equal documents the
row of least id stays, and one of rows with the same id and text; a null id
counts as greater than any; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import near_dups, packing, pii, quality, substrings
from corpusloom.llm.common import table
from corpusloom.sources.session import materialise, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where it has that column, true of the text again."""
    return docs.select(
        *[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least id."""
    ship_package(spark)
    return near_dups.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 400 bytes that occur again anywhere."""
    ship_package(spark)
    return _measured(substrings.remove_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    ship_package(spark)
    return _measured(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and their places in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
