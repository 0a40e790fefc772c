"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, near_dedup, packing, pii, toxicity
from plumbline.llm.common import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to `labels`, doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data."""
    return pii.surrogates(docs, keep_columns=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: where it is in which training sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", clean), ("exact_dedup", distinct_texts), ("near_dedup", distinct_contents), ("pii", private), ("packing", packed)]

#: Trained models and tokenizers are beyond SQL; tests hold each stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` below sf_dir; what a stage returns is kept in the shared folder until the next has read it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        to = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
