"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold while an intermediate table is written.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.ui.explainMode": "simple", "spark.sql.maxPlanStringLength": "20000"}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir, or a temporary one where that is unset (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='wharfline-')}"
    return f"{base.rstrip('/')}/wharfline-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage, and survives lost executors.

    Its shuffle files go when the write ends; the plan is not run again, so nothing would read them. The driver keeps a description of every
    plan, so those of intermediate tables are kept short. The settings are the session's own again afterwards.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, what)
    before = {name: spark.conf.get(name, None) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
