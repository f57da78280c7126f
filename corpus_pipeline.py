"""From raw documents to a training mix: language ID, near duplicates, decontamination, secrets, mixing.

Each stage takes what the one before it kept, from Parquet. Only the last returns other columns than those of documents.

Defined results: documents with a null text or without a letter end at the first stage, which cannot tell their language; nulls in other columns
are kept. Documents without an id pass near_duplicates, since nothing can name them. Of copies the least id stays, with every row
that repeats it; repeated rows are repeated in the mix. Very long texts go through whole. Ties (of language scores, copies, draws) are settled as
each operator's docstring says. Extra columns come through up to the mix, whatever their names. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import decontaminate, jaccard_join, langid, mixing, secret_scan
from wharfline.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the documents that are not held out."""
    return langid.keep_accepted(docs, langid.fit_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    return jaccard_join.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted again where the text has changed."""
    masked = secret_scan.redact(secret_scan.scan(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document enters the mix."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("secrets", secrets), ("mixture", mixture)]

#: SQL cannot train the language model; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
