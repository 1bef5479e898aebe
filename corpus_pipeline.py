"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.llm import jaccard, langid, mixing, packing, pii
from prismtab.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing lang is filled with the predicted one."""
    named = langid.identify(docs.withColumn("_row", F.struct(*docs.columns)), langid.train(docs))
    kept = named.where(F.col("lang_pred") != langid.UNKNOWN)
    filled = {"lang": F.coalesce(F.col("_row.lang"), F.col("lang_pred"))}
    return kept.select(*(filled.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more stays: the smallest doc_id."""
    return jaccard.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; n_chars follows."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; documents may leave, or come up to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("pack", pack)]

#: A trained network and dynamic programming are not SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
