"""The corpus pipeline over documents: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, jaccard_join, langid, packing, secret_scan
from panelforge.llm.common import delete, scratch, shared_dir


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models, trained on all labelled documents, don't reject."""
    model = langid.train(docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    if model is None:  # no labelled text: there is nothing to judge by
        return docs
    said = langid.predict(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, text_col="in_text")
    return said.filter(~F.col("rejected")).select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten-word windows of benchmark items."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.redacted(docs, secret_scan.train(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None  # the language models, the forest and the packing plan are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder and read again.

    A stage's own tables and its input go when it is written; what stays is the last stage's folder. Without documents
    there are no rows; null texts and null languages fall to the first stage's rules.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
