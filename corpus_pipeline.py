"""Corpus preparation: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows that its predecessor kept; all but the last give
the columns of ``documents``. Stages are written as Parquet and read again, so
each starts from a fixed table and a lost executor repeats tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import materialize, tune
from tidemark.llm import exact_dedup, mixing, near_dedup, packing, quality
from tidemark.llm.queries import tokenizer_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade, good and not toxic, is ``CLEAN_LEAST`` or more.

    NULL and empty texts are judged by the thresholds alone; without labels, or on an empty table, all rows stay.
    """
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.selected(docs, quality.model_for(docs, labels), quality.CLEAN, quality.CLEAN_LEAST)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tune(spark)
    return exact_dedup.kept_documents(docs, materialize(exact_dedup.deduplicate(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without id stay, and so do rows that share an id with one that is kept.
    """
    tune(spark)
    judged = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"] == F.col("_gone_id"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    NULL sources are a source of their own, NULL and empty texts have size zero; an empty table stays empty.
    """
    tune(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences.

    A document without text is one piece of the end token; rows that share an id are documents of their own.
    """
    tune(spark)
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", source_mix),
    ("pack", packed),
]

#: the classifier and the tokenizer have no SQL form; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
