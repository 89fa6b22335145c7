"""The corpus pipeline: toxicity, exact dedup, near dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careledger.llm.catalog import tokenizer_file
from careledger.llm.exact_dedup import exact_unique
from careledger.llm.minhash import LAYOUT_80, near_unique
from careledger.llm.packing import pack
from careledger.llm.shared import cut, table
from careledger.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    return exact_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays; 0.8 alike or more is near."""
    return near_unique(docs, percent=80, layout=LAYOUT_80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is cut into pieces and packed into sequences."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


#: Each stage works on all that the one before kept.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL has no tokenizer and no learned lexicon; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
